"""The workflow: stages return lazy tables; what they are made from is written once, after entity resolution."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholar_spark import schema as S
from scholar_spark.config import resolve_config
from scholar_spark.functions import text as X
from scholar_spark.operators import entities, geo, graph, linkage, metrics, themes
from scholar_spark.operators.lineage import cut
from scholar_spark.sources import readers
from scholar_spark.sources.sinks import Manifest

ANALYSES = ("summary", "articles", "authors", "bradford", "hot", "team", "landscape")


@dataclass
class Stage:
    data: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)


def as_articles(fused: DataFrame) -> DataFrame:
    """The fused article table with the short column names that the metrics read."""
    authors = X.chosen_authors(F.col("`Author Full Names`"), F.col("Authors"))
    return fused.withColumns(
        {
            "id": F.col("row_id"), "year": F.col("`Publication Year`").cast("int"), "cites": F.col("`Cited by`"),
            "source": X.source_key(F.col("`Source Title`")), "doc_type": F.col("`Document Type`"), "authors": X.pieces(authors),
            "refs": F.col("`Cited Reference Count`"),
            **{n: X.pieces(F.col(f"`{c}`")) for n, c in (("keywords", "Author Keywords"), ("index_keywords", "Keywords Plus")) if c in fused.columns},
        }
    )


def run_ingestion(exports: list[readers.Export], config: dict | None = None) -> Stage:
    config = resolve_config(config)
    cutoff = config["as_of_year"] if config["apply_time_filter"] else None
    tables = readers.ingest(exports, cutoff)
    if "prisma" in tables:
        tables["prisma_table"] = linkage.prisma_table(tables["prisma"])
    return Stage(tables["articles"], tables, [w for e in exports for w in e.warnings], {"cutoff": cutoff})


def run_entity_resolution(stage: Stage, aliases: dict | None = None) -> Stage:
    keys, collisions = entities.flatten_aliases(aliases)
    data, table = map(cut, entities.resolve(stage.data, keys))  # every later table is made from these two
    return Stage(data, {"affiliations": table, **entities.resolution_audit(table)}, metadata={"collisions": collisions})


def run_corpus(stage: Stage, config: dict) -> Stage:
    rows, year = metrics.add_mncs(as_articles(stage.data)), config["as_of_year"]
    production, titles = metrics.annual_production(rows), metrics.source_titles(rows, "Source Title")
    sources = metrics.source_metrics(rows, year).join(titles, "source", "left")
    tables = {
        "characteristics": metrics.corpus_characteristics(rows, year), "mncs_baselines": metrics.mncs_baselines(rows), "mncs_audit": metrics.mncs_audit(rows),
        "doc_types": metrics.doc_types(rows), "authors": metrics.author_productivity(rows), "annual": production, "trend": metrics.trend_test(metrics.trend(production)),
        "citation_dynamics": metrics.citation_dynamics(rows, year), "sources": sources,
        **{f"sources_by_{k}": v for k, v in metrics.source_rankings(sources, config["min_papers"], config["top_n"]).items()},
    }
    return Stage(rows, tables)


def run_advanced(stage: Stage, config: dict, analyses=ANALYSES) -> Stage:
    """The chosen analyses; an unknown one is an error."""
    if unknown := set(analyses) - set(ANALYSES):
        raise ValueError(f"unknown analyses: {sorted(unknown)}")
    rows, year, top = stage.data, config["as_of_year"], config["top_n"]
    ranked = metrics.bradford(rows)
    made = {
        "summary": {"summary": metrics.final_summary(rows, year), "document_snapshot": metrics.document_snapshot(rows)},
        "articles": {"articles": metrics.article_ranking(rows, top), "article_ranks": metrics.article_ranks(rows)},
        "authors": {"author_impact": metrics.author_impact(rows, top)},
        "bradford": {"bradford": ranked, "bradford_zones": metrics.bradford_zones(ranked)},
        "hot": {"hot_papers": metrics.hot_papers(rows, year, top)},
        "team": {"team_size": metrics.team_size(rows)},
        "landscape": {"landscape": metrics.landscape(rows)},
    }
    return Stage(rows, {k: t for a in ANALYSES if a in analyses for k, t in made[a].items()})


def run_geography(stage: Stage, config: dict) -> Stage:
    rows = stage.data
    if config["drop_unknown_countries"]:
        known = rows.where(F.size("countries") > 0)
    else:
        known = rows.withColumn("countries", F.when(F.size("countries") == 0, F.array(F.lit("Unknown"))).otherwise(F.col("countries")))
    table, edges = geo.country_table(known), graph.pair_edges(known, "countries")
    tables = {
        "classification": geo.classification(rows), "countries": table, "impact": geo.impact(table, config["min_papers"], config["top_n"]),
        "matrix": geo.matrix(table, config["min_papers"]), "tiers": geo.tiers(table), "grid": geo.year_grid(known), "edges": edges, "strongest": graph.top_ties(edges, 5), "top_cited": geo.top_cited(table, config["top_n"]), "labelled": geo.labelled(table),
    }
    return Stage(rows, tables)


def run_country_case(stage: Stage, country: str, top: int = 10) -> Stage:
    if stage.data.where(F.array_contains("countries", country)).limit(1).isEmpty():
        near = geo.similar_names(geo.country_table(stage.data), country)
        raise ValueError(f"no articles of {country}; names like it: {', '.join(near) or 'none'}")
    return Stage(stage.data, geo.case_study(stage.data, country, top))


def run_institutions(stage: Stage, scope: str, config: dict) -> Stage:
    """Ranking, network and communities of one of the six scopes; communities are left out where the network is too large."""
    rows = entities.in_scope(entities.prepare_institutions(stage.data), scope)
    return _network(rows, config, {"scope": scope})


def run_topic_institutions(stage: Stage, topic: int, scope: str, config: dict) -> Stage:
    """The same for the articles whose first topic is ``topic``; ``stage`` is one of ``run_topics``."""
    rows = entities.in_scope(entities.prepare_institutions(themes.of_topic(stage.data, topic)), scope)
    if rows.isEmpty():
        raise ValueError(f"no articles of topic {topic} in scope {scope}")
    return _network(rows, config, {"scope": scope, "topic": topic})


def _network(rows: DataFrame, config: dict, metadata: dict) -> Stage:
    most = config["max_institutions_per_paper"]
    edges, rank = graph.pair_edges(rows, "institutions", most), graph.ranking(rows)
    mean = rows.select(F.explode("institutions").alias("node"), "mncs") if "mncs" in rows.columns else None
    nodes = graph.node_degrees(edges).join(graph.betweenness(edges), "node", "left")
    nodes = nodes.join(rank.select(F.col("item").alias("node"), F.col("n").alias("productivity")), "node", "left")
    if mean is not None:
        nodes = nodes.join(mean.groupBy("node").agg(F.avg("mncs").alias("mean_mncs")), "node", "left")
    tables = {"ranking": rank, "edges": edges, "nodes": nodes, "audit": graph.edge_audit(rows, "institutions", most), "strong": graph.strong_ties(edges)}
    warnings = []
    try:
        tables |= run_communities(edges, rank)
    except ValueError as e:
        warnings.append(str(e))
    return Stage(rows, tables, warnings, metadata)


def run_communities(edges: DataFrame, rank: DataFrame) -> dict[str, DataFrame]:
    """Members with productivity and strength, communities with size and leader, and edges inside and between them."""
    members = graph.communities(edges)
    member_table, community_table = graph.community_tables(edges, members, rank)
    return {"members": member_table, "communities": community_table, "edge_classes": graph.edge_classes(edges, members)}


def run_thematic(stage: Stage, config: dict) -> Stage:
    """Processed texts and their n-grams."""
    noise = themes.noise_terms(config["search_query"])
    rows = stage.data.withColumn("combined", themes.combined_text()).withColumn("processed", themes.processed(F.col("combined"), noise))
    found = themes.frequent_ngrams(rows, config["min_df"], config["max_df"], text="processed")
    tables = {"ngrams": found, **{name: found.where(F.col("n") == k) for k, name in enumerate(("unigrams", "bigrams", "trigrams", "quadgrams"), 1)}}
    return Stage(rows, tables)


def run_topics(stage: Stage, config: dict, k: int | None = None) -> Stage:
    """LDA and NMF for each topic number; the tables of the LDA model of the best coherence (the first of
    several) unless ``k`` is given, and the NMF topics of the same number."""
    rows, words = themes.document_terms(stage.data)
    n = rows.count()
    grid = themes.k_grid(config["topic_candidates"] if k is None else [k], n, len(words))
    terms, weights = rows.select("id", F.explode(F.array_distinct("tokens")).alias("term")), cut(themes.term_weights(rows))
    scores, best = [], None
    for size in grid:
        model = themes.fit_lda(rows, size, seed=config["seed"])
        score = themes.umass_coherence(themes.topic_terms(model, words, 20), terms).first()["coherence"]
        parts = themes.fit_nmf(weights, size, config["nmf_iterations"], config["seed"])
        other = themes.umass_coherence(themes.nmf_terms(parts[1], 20), terms).first()["coherence"]
        scores.append((size, float(model.logPerplexity(rows)), score, other, parts[2][-1]))
        if best is None or (score or float("-inf")) > (best[1] or float("-inf")):
            best = (size, score, model, parts)
    size, _, model, (w, h, _) = best
    out, width = themes.with_topics(model, rows), config["topic_bin_years"]
    tables = {
        "evaluation": rows.sparkSession.createDataFrame(scores, "k int, log_perplexity double, coherence double, nmf_coherence double, nmf_loss double"),
        "topics": themes.describe_topics(model, words), "nmf_topics": themes.joined_terms(themes.nmf_terms(h)),
        "nmf_assignments": w.select("id", F.array_position("w", F.array_max("w")).cast("int").alias("topic")),
        "evolution": themes.topic_evolution(out, width, size), "counts": themes.topic_counts(out, width, size), "assignments": out.select("id", "Title", "year", "topic"),
    }
    if "mncs" in out.columns:
        tables |= {"impact": themes.topic_impact(out), "first_articles": themes.top_articles(out)}
    if "countries" in out.columns:
        tables["activity"] = themes.activity_index(out, config["min_country_documents"])
    tables["cooccurrence"] = themes.topic_cooccurrence(out, size, config["topic_cooccurrence"])
    return Stage(out, tables, metadata={"k": size})


def run_workflow(exports: list[readers.Export], config: dict | None = None, aliases: dict | None = None, ingestion: Stage | None = None) -> tuple[dict[str, Stage], Manifest]:
    """All stages; an optional one that cannot run is listed as skipped. ``ingestion``, as ``store.stored_ingestion``
    gives it, takes the place of reading the exports.

    The case study runs where the setting ``country`` names one, the networks of single topics for the
    scopes in ``topic_scopes``.
    """
    config = resolve_config(config)
    if config["as_of_year"] is None:
        raise ValueError("as_of_year must be given: no operator reads the clock")
    manifest, stages = Manifest(), {}
    tell = config["progress"] or (lambda *a: None)

    def record(name, make, optional=False):
        tell(name, "running", "")
        try:
            stages[name] = make()
            manifest.add(name, "Completed", stages[name].metadata.get("documents"), stages[name].warnings)
        except ValueError as e:
            if not optional:
                raise
            manifest.add(name, "Skipped", detail=str(e))
            tell(name, "skipped", str(e))
            return
        tell(name, "done", "")

    record("ingestion", lambda: ingestion or run_ingestion(exports, config))
    record("entities", lambda: run_entity_resolution(stages["ingestion"], aliases))
    record("corpus", lambda: run_corpus(stages["entities"], config))
    record("geography", lambda: run_geography(stages["corpus"], config))
    record("advanced", lambda: run_advanced(stages["corpus"], config))
    record("thematic", lambda: run_thematic(stages["corpus"], config), True)
    for scope in S.SCOPES:
        record(f"institutions_{scope}", lambda scope=scope: run_institutions(stages["corpus"], scope, config), True)
    if config["country"]:
        record("country_case", lambda: run_country_case(stages["corpus"], config["country"], config["top_n"]), True)
    if config["topics"] and "thematic" in stages:
        record("topics", lambda: run_topics(stages["thematic"], config), True)
    for topic in range(1, stages["topics"].metadata["k"] + 1) if "topics" in stages else ():
        for scope in config["topic_scopes"]:
            record(f"topic_{topic}_{scope}", lambda t=topic, scope=scope: run_topic_institutions(stages["topics"], t, scope, config), True)
    return stages, manifest
