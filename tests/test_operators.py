"""Small cases for cleaning, linkage, entities, metrics, graphs and readers."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F
from scholar_spark import schema as S
from scholar_spark.config import resolve_config
from scholar_spark.functions import text as X
from scholar_spark.operators import entities, geo, graph, linkage, metrics, themes
from scholar_spark.plans import workflow
from scholar_spark.sources import readers, sinks


def values(spark, f, *xs):
    """What a column function makes of each value."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_doi_forms(spark):
    same = ["10.1000/Example", " doi:10.1000/example.", "https://doi.org/10.1000/EXAMPLE;", "http://dx.doi.org/10.1000/example,", "10.1000/ exa mple", "DOI: 10.1000/example"]
    assert set(values(spark, X.doi, *same)) == {"10.1000/example"}
    assert set(values(spark, X.doi, None, *S.MISSING, "NaN", " None ")) == {None}
    assert values(spark, X.doi, "10.1000/a(b):c_d;") == ["10.1000/a(b):c_d"]


def test_scalars(spark):
    assert values(spark, X.authors_scopus, "Doe J.; ; Smith A.", None) == ["Doe J.; Smith A.", ""]
    assert values(spark, X.authors_wos, "DOE J,  SMITH A", "A, B; C, D") == ["DOE J; SMITH A", "A, B; C, D"]
    assert values(spark, X.without_ids, "Smith, John (123)") == ["Smith, John"]
    assert values(spark, X.reference_count, "A; B;C", "", " ", "NA", None) == [3, 0, 0, None, None]
    assert values(spark, X.title_key, "A Title: Two!", "", "nan") == ["atitletwo", None, None]
    assert values(spark, X.year_key, "2020.0", "2020.5", "x", None) == ["2020", None, None, None]
    assert values(spark, X.doc_type, "Article", " review ", "Proceedings Paper", "proceeding paper") == ["Article", "Review", "Other", "Conference"]
    assert values(spark, X.source_key, "Science & Co-op: A!", "R&D") == ["science and co op a", "randd"]
    assert values(spark, X.journal_title, "the JOURNAL of ieee o'neil", None) == ["The Journal of IEEE O'Neil", None]
    assert values(spark, X.strip_accents, "Zürich é", "abc") == ["Zurich e", "abc"]
    assert values(spark, X.lookup_key, "The University of  X and Y") == ["university x y"]
    assert values(spark, X.clean_affiliation, "[A, B] Univ. Paris , France &amp; Co") == ["UnivParis, France & Co"]
    assert X.search_terms('("deep learning" OR graphs) AND x-ray') >= {"deep learning", "deep", "learning", "graphs", "x-ray"}
    assert values(spark, lambda c: X.only_eu(F.split(c, ";")), "Germany;Czechia", "Germany;Japan") == [True, False]
    assert values(spark, X.list_of, "['a', 'b']", '["c"]', None) == [["a", "b"], ["c"], []]


def records(spark, rows):
    cols = "row_id string, DOI string, Title string, `Publication Year` double, `Cited by` double, Abstract string, `Cited References Raw` string, `Primary Database` string, Databases array<string>, `Source Files` array<string>"
    return spark.createDataFrame(rows, cols)


def test_fusion_and_provenance(spark):
    rows = [
        ("0", "10.1000/EXAMPLE", "T", 2020.0, 5.0, None, "Ref A; Ref B", "Scopus", ["Scopus"], ["scopus_part_1.csv"]),
        ("1", "https://doi.org/10.1000/example", "T2", 2020.0, 3.0, "abs", None, "Web of Science", ["Web of Science"], ["wos_part_2.txt", "SCOPUS_part_1.csv"]),
    ]
    out = linkage.fuse(records(spark, rows)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["Title"], r["Abstract"], r["Primary Database"]) == ("T", "abs", "Scopus")
    assert r["Databases"] == ["Scopus", "Web of Science"] and r["Source Files"] == ["scopus_part_1.csv", "wos_part_2.txt"]
    assert r["Cited References Raw"] == "Ref A; Ref B" and r["filled"] == ["Abstract"] and r["group_size"] == 2


def test_rows_without_doi(spark):
    rows = [(str(i), d, t, y, None, None, None, "Scopus", ["Scopus"], ["f"]) for i, (d, t, y) in enumerate(
        [("NA", "Same", 2020.0), (None, "same!", 2020.0), ("", "Same", 2021.0), (None, None, 2020.0), (None, None, 2020.0), (None, "Same", None), (None, "Same", None), (None, None, None), (None, None, None), ("10.1/x", "Same", 2020.0)]
    )]
    df = records(spark, rows)
    fused = linkage.fuse(df)
    counts = linkage.prisma(df, fused).first()
    assert fused.count() == 9 and counts["n_fused_groups"] == 1 and counts["n_removed_title_year"] == 1
    assert counts["n_merged"] - counts["n_removed_doi"] - counts["n_removed_title_year"] == counts["n_final"]
    assert "holds" in linkage.prisma_text(counts.asDict())


def test_fusion_is_the_same_after_repartitioning(spark):
    rng = random.Random(1)
    rows = [(f"{i:04}", f"10.1/{rng.randrange(30)}", f"t{i}", 2000.0, rng.choice([None, 1.0, 2.0]), rng.choice([None, f"a{i}"]), rng.choice([None, "", "r"]), "Scopus", ["Scopus"], [f"f{i % 5}"]) for i in range(200)]
    want = sorted(map(str, linkage.fuse(records(spark, rows)).collect()))
    rng.shuffle(rows)
    assert sorted(map(str, linkage.fuse(records(spark, rows).repartition(7)).collect())) == want
    best = {}
    for r in sorted(rows, key=lambda r: (-(r[4] if r[4] is not None else -1), r[0])):
        best.setdefault(r[1], []).append(r)
    got = {r["key"][4:]: r for r in linkage.fuse(records(spark, rows)).collect()}
    for doi, group in best.items():
        assert got[doi]["Title"] == group[0][2]
        assert got[doi]["Abstract"] == next((r[5] for r in group if r[5] is not None), None)
        assert got[doi]["Cited References Raw"] == next((r[6] for r in group if r[6] is not None), None)


def art(spark, rows, cols="id int, year int, cites double, source string, authors array<string>, countries array<string>"):
    return spark.createDataFrame(rows, cols)


def test_mncs(spark):
    rows = [(i, y, c, "s", ["a"], []) for i, (y, c) in enumerate([(2020, 2.0), (2020, 6.0), (2021, 0.0), (2021, 0.0), (2022, None), (None, 3.0)])]
    got = {r["id"]: r for r in metrics.add_mncs(art(spark, rows)).collect()}
    assert [got[i]["mncs"] for i in range(6)] == [0.5, 1.5, None, None, None, None]
    assert got[0]["ref_mean"] == 4 and got[0]["ref_size"] == 2 and got[2]["ref_mean"] == 0 and not got[2]["mncs_defined"]
    none = art(spark, [(1, 2020, None, "s", ["a"], []), (2, 2020, None, "s", ["b"], [])])
    assert [r["mncs"] for r in metrics.add_mncs(none).collect()] == [None, None]
    assert metrics.citation_dynamics(none, 2024).count() == 1


def test_h_and_g_equal_the_loops(spark):
    rng = random.Random(3)
    rows = [(i, 2000, rng.choice([None, 0.0, 1.0, 2.0, 3.0, 8.0, 30.0, 200.0]), f"s{rng.randrange(25)}", [], []) for i in range(400)]
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(int(r[2] or 0))
    for r in metrics.h_index(art(spark, rows), ["source"]).collect():
        c = sorted(by[r["source"]], reverse=True)
        h = g = 0
        while h < len(c) and c[h] >= h + 1:
            h += 1
        while g < len(c) and sum(c[: g + 1]) >= (g + 1) ** 2:
            g += 1
        assert (r["h"], r["g"]) == (h, g), c


def test_bradford_and_credit(spark):
    rng = random.Random(5)
    rows = [(i, 2000, 1.0, f"s{min(rng.randrange(40), rng.randrange(40))}", [f"a{rng.randrange(9)}" for _ in range(rng.randrange(5))], []) for i in range(300)]
    df = art(spark, rows).withColumn("mncs", F.lit(1.0))
    ranked = metrics.bradford(df)
    zones = {r["zone"]: r for r in metrics.bradford_zones(ranked).collect()}
    assert sum(z["articles"] for z in zones.values()) == 300 and zones[3]["sources"] > zones[1]["sources"]
    run = 0
    for r in sorted(ranked.collect(), key=lambda r: r["rank"]):
        run += r["n"]
        assert r["running"] == run
    credit = metrics.author_productivity(df).agg(F.sum("credit")).first()[0]
    assert credit == pytest.approx(sum(bool(r[4]) for r in rows))


def test_trend_and_p_value(spark):
    df = spark.createDataFrame([(2000 + i, 3 + 2 * i) for i in range(6)], "year int, n int")
    t = metrics.trend(df).first()
    assert t["slope"] == pytest.approx(2) and t["r2"] == pytest.approx(1) and t["stderr"] == pytest.approx(0, abs=1e-6)
    assert metrics.trend(spark.createDataFrame([(2000, 3), (2001, 3)], "year int, n int")).first()["r2"] == 0
    assert metrics.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert metrics.t_two_sided(0.5, 3) == pytest.approx(0.6514482, abs=1e-6)


def test_entities(spark):
    rows = [("0", "Caltech, Pasadena, CA 91125 USA; Max Planck Inst Astron, Heidelberg, Germany"), ("1", "ETH Zurich, Switzerland"), ("2", None), ("3", "Dept Phys, Univ Calif Berkeley, USA; Nowhere, Atlantis")]
    df = spark.createDataFrame(rows, "row_id string, Affiliations string")
    out, table = entities.resolve(df, entities.flatten_aliases({"caltech updated": ["caltech"]})[0])
    got = {r["row_id"]: r for r in out.collect()}
    assert "Caltech Updated" in got["0"]["institutions"] and "Max Planck Institute" in got["0"]["institutions"]
    assert got["0"]["countries"] == ["Germany", "United States"] and got["0"]["classification"] == "International"
    assert got["1"]["institutions"] == ["ETH Zurich"] and got["2"]["countries"] == [] and got["3"]["countries"] == ["United States"]
    assert entities.resolution_audit(table)["unresolved_countries"].count() == 1
    names = spark.createDataFrame([(x,) for x in ("Czech Republic", "CZECH REP.", "Czechia", "PEOPLES R CHINA", "South Korea", "deu", "Bosnia & Herceg")], "raw string")
    assert {r["raw"]: r["country"] for r in entities.resolve_countries(names).collect()} == {
        "Czech Republic": "Czechia", "CZECH REP.": "Czechia", "Czechia": "Czechia", "PEOPLES R CHINA": "China", "South Korea": "South Korea", "deu": "Germany",
        "Bosnia & Herceg": "Bosnia and Herzegovina",
    }
    assert len(entities.flatten_aliases({"A": ["x"], "B": ["x"]})[1]) == 1
    with pytest.raises(ValueError):
        entities.flatten_aliases({})


def test_geography_and_scopes(spark):
    sets = [["Germany"]] * 4 + [["France"]] * 8 + [["Germany", "France"]] * 8 + [["Japan", "France"]] * 3 + [[]]
    df = art(spark, [(i, 2020, 1.0, "s", [], c) for i, c in enumerate(sets)]).withColumn("mncs", F.lit(1.0))
    got = {r["country"]: (r["articles"], r["scp"], r["mcp"]) for r in geo.country_table(df).collect()}
    assert got["Germany"] == (12, 4, 8) and {r["class"]: r["n"] for r in geo.classification(df).collect()} == {"SCP": 12, "MCP": 11, "Unknown": 1}
    assert {s: entities.in_scope(df, s).count() for s in S.SCOPES} == {"Global_All": 24, "Global_MCP": 11, "Global_SCP": 12, "EU_All": 20, "EU_MCP": 8, "EU_SCP": 12}
    grid = geo.year_grid(df).collect()
    assert [(r["country"], r["rank"]) for r in sorted(grid, key=lambda r: r["rank"])][0][0] == "France"
    with pytest.raises(ValueError, match="Germany"):
        workflow.run_country_case(workflow.Stage(df), "germ")


def test_networks(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["a", "b", "b"]), (3, list("defghi")), (4, ["d"]), (5, ["d", "e"])]
    df = spark.createDataFrame(rows, "id int, institutions array<string>")
    edges = graph.pair_edges(df, "institutions", 5)
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("d", "e"): 1}
    assert graph.edge_audit(df, "institutions", 5).first()["n_excluded"] == 1
    line = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "src string, dst string, weight int")
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(line).collect()}
    assert got == pytest.approx({"a": 0, "b": 2 / 3, "c": 2 / 3, "d": 0})
    ring = [(f"{g}{i}", f"{g}{j}", 5.0) for g in "xyz" for i in range(5) for j in range(i + 1, 5)] + [("x0", "y0", 1.0), ("y1", "z1", 1.0)]
    of = graph.louvain(ring)
    assert len(set(of.values())) == 3 and all(len({of[f"{g}{i}"] for i in range(5)}) == 1 for g in "xyz")
    assert graph.modularity(ring, of) > 0.6
    e = spark.createDataFrame(ring, "src string, dst string, weight double")
    members = graph.communities(e)
    assert graph.normalized_mutual_information(members, members).first()["nmi"] == pytest.approx(1)
    assert graph.edge_classes(e, members).where("NOT inside").count() == 2
    assert graph.community_tables(e, members, graph.ranking(df))[1].count() == 3
    assert graph.graphml([{"node": "a<b", "n": 1}], [{"src": "a<b", "dst": "c", "weight": 2}]).count("<edge") == 1


def test_text_and_topics(spark):
    got = values(spark, lambda c: themes.processed(c, ["using", "deep"]), "Using Deep studies classes embedding, sequencing embedded X-rays boss")
    assert got == ["study classe embedding sequencing embedded x-ray boss"]
    docs = spark.createDataFrame([(i, "artificial intelligence machine learning") for i in range(3)], "id int, text string")
    pairs = {r["ngram"]: (r["total"], r["df"]) for r in themes.frequent_ngrams(docs, 1, 1.0, n=(2, 2)).collect()}
    assert pairs["artificial intelligence"] == (3, 3) and pairs["machine learning"] == (3, 3)
    odd = spark.createDataFrame([("a a", 2), ("machine learning ml", 3), ("x y", 2), ("oxford press", 2)], "ngram string, n int")
    assert [r["ngram"] for r in themes.ngram_filters(odd).collect()] == ["x y"]
    assert themes.k_grid([3, 4, 5], 5, 100) == [3, 4] and themes.k_grid([9], 5, 100) == [4] and themes.min_df(2000) == 20
    words = ["star planet orbit", "gene cell protein", "bank money trade"]
    rows = [(i, " ".join(random.Random(i).choices(words[i % 3].split(), k=30))) for i in range(18)]
    held, vocabulary = themes.document_terms(spark.createDataFrame(rows, "id int, processed string"))
    model = themes.fit_lda(held, 3, 30)
    out = themes.with_topics(model, held).collect()
    assert all(abs(sum(r["topic_mix"]) - 1) < 1e-6 and 1 <= r["topic"] <= 3 for r in out)
    assert themes.describe_topics(model, vocabulary, 3).count() == 3
    tf = held.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    w, h, losses = themes.fit_nmf(tf, 3, 15)
    assert all(b <= a + 1e-6 for a, b in zip(losses, losses[1:])) and min(min(r["w"]) for r in w.collect()) >= 0 and h.count() == 9


def test_readers(spark, tmp_path):
    (tmp_path / "q_2.csv").write_text('Title,Year,References,Abstract,DOI\n"A, b",2020,,NA,10.1/a\nB,2021,NA,,\nC,2022,"R1; R2",text,10.1/c,extra,fields\nShort,2019\n', encoding="utf-8-sig")
    (tmp_path / "q_1.csv").write_text("Title,Year,References,Abstract,DOI\nD,2018,R1;R2;R3,x,10.1/A\n")
    df, how = readers.read_export(spark, str(tmp_path / "q_2.csv"))
    got = {r["Title"]: r for r in df.collect()}
    assert how == "comma" and set(got) == {"A, b", "B", "Short"}
    assert got["A, b"]["References"] == "" and got["B"]["References"] is None and got["Short"]["References"] is None and got["A, b"]["Abstract"] is None
    export = readers.read_source(spark, [str(tmp_path / "q_2.csv"), str(tmp_path / "q_1.csv")], split=True)
    assert [f["file"] for f in export.files] == ["q_1.csv", "q_2.csv"] and export.source == "Scopus"
    assert readers.summary(export).first()["rows_sharing_doi"] == 2
    out = readers.ingest([export], 2022)
    rows = {r["Title"]: r for r in out["articles"].collect()}
    assert set(rows) == {"D", "B", "Short"} and rows["D"]["Cited Reference Count"] == 3 and sorted(rows["D"]["Source Files"]) == ["q_1.csv", "q_2.csv"]
    with pytest.raises(readers.InputError):
        readers.read_source(spark, [str(tmp_path / "q_1.csv"), str(tmp_path / "r_2.csv")], split=True)
    with pytest.raises(readers.InputError):
        readers.read_export(spark, str(tmp_path / "x.pdf"))
    (tmp_path / "w.txt").write_text("FN Clarivate\nVR 1.0\nPT J\nAU Smith, J\n   Doe, A\nTI A long\n   title\nPY 2020\nCR Ref 1\n   Ref 2\n   Ref 3\nER\n\nPT J\nAU Roe, B\nTI Other\nER\n\nEF\n")
    df, how = readers.read_export(spark, str(tmp_path / "w.txt"))
    got = {r["TI"]: r for r in df.collect()}
    assert how == "tagged" and got["A long title"]["AU"] == "Smith, J; Doe, A" and len(got) == 2
    wos = readers.harmonize([readers.Export(df, "WoS", [])]).collect()
    assert {r["Title"]: r["Cited Reference Count"] for r in wos} == {"A long title": 3, "Other": None}
    (tmp_path / "t.xls").write_text("Article Title\tPublication Year\nX\t2020\n")
    df, how = readers.read_export(spark, str(tmp_path / "t.xls"))
    assert df.first()["Article Title"] == "X"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Title</t></si><si><t>References</t></si><si><t>One</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c></row></sheetData></worksheet>')
    df, _ = readers.read_export(spark, str(tmp_path / "b.xlsx"))
    assert df.first()["Title"] == "One" and df.first()["References"] == ""
    with pytest.raises(readers.InputError):
        readers.from_frame(spark.createDataFrame([("x",)], f"`{S.SOURCE_FILE}` string"))
    assert readers.detect_source(["Title", "Cited by"]) == "Scopus" and readers.detect_source(["Title", "TI"]) == "WoS"


def test_workflow_and_sinks(spark, tmp_path):
    head = "Title,Authors,Author full names,Source title,Year,Cited by,DOI,Abstract,Author Keywords,Index Keywords,Document Type,Affiliations,References\n"
    names = ["Germany", "France", "Japan"]
    lines = [f'"Work {i}",A{i % 4} B.;C{i % 3} D.,,Journal {i % 3},{2018 + i % 5},{i},10.1/{i % 17},"graph network {names[i % 3]} learning",k{i % 2},,Article,"University of X{i % 4}, City, {names[i % 3]}; University of Y{i % 2}, Town, {names[(i + i % 2) % 3]}",R1; R2' for i in range(18)]
    (tmp_path / "s.csv").write_text(head + "\n".join(lines) + "\n")
    export = readers.read_source(spark, [str(tmp_path / "s.csv")])
    with pytest.raises(ValueError):
        workflow.run_workflow([export], {"nonsense": 1})
    with pytest.raises(ValueError):
        resolve_config({"x": 1})
    config = {"as_of_year": 2024, "min_df": 1, "max_df": 1.0, "min_papers": 1, "topics": False, "country": "Germany"}
    stages, manifest = workflow.run_workflow([export], config)
    assert stages["ingestion"].tables["prisma"].first()["n_final"] == 17
    assert stages["corpus"].tables["characteristics"].first()["documents"] == 17
    means = stages["corpus"].data.where("mncs IS NOT NULL").groupBy("year").agg(F.avg("mncs").alias("m")).collect()
    assert all(r["m"] == pytest.approx(1, abs=1e-10) for r in means)
    assert stages["geography"].tables["countries"].count() == 3
    assert stages["advanced"].tables["team_size"].count() == 6
    assert stages["thematic"].tables["bigrams"].count() > 0
    assert stages["institutions_Global_All"].tables["nodes"].count() > 0
    assert manifest.table(spark).count() == 13 and stages["country_case"].tables
    out = sinks.csv_text(stages["ingestion"].data)
    assert out.startswith("﻿") and '"[""s.csv""]"' in out and out == sinks.csv_text(stages["ingestion"].data)
    sinks.write_csv(stages["ingestion"].data, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 17
    assert sinks.canonical_json({"b": {"Z", "a"}, "A": [2, 1]}) == '{"A": [2, 1], "b": ["a", "Z"]}'
    with pytest.raises(ValueError):
        workflow.run_advanced(stages["corpus"], resolve_config(config), ["unknown"])
    topics = workflow.run_topics(stages["thematic"], resolve_config(config | {"topic_candidates": (2,), "nmf_iterations": 4}))
    assert topics.metadata["k"] == 2 and topics.tables["counts"].count() >= 1
    assert topics.tables["topics"].count() == topics.tables["nmf_topics"].count() == 2 and topics.tables["nmf_assignments"].count() == 17
    one = topics.data.first()["topic"]
    network = workflow.run_topic_institutions(topics, one, "Global_All", resolve_config(config))
    assert network.metadata == {"scope": "Global_All", "topic": one} and {"productivity", "mean_mncs"} <= set(network.tables["nodes"].columns)
    with pytest.raises(ValueError):
        workflow.run_topic_institutions(topics, 9, "Global_All", resolve_config(config))
    assert stages["ingestion"].tables["prisma_table"].count() == 10
    assert 0 <= stages["corpus"].tables["trend"].first()["p_value"] <= 1


def test_institution_scores_follow_the_rules_in_order(spark):
    """Points by hand: the word univ counts only where the points before it, street words and bonuses included, exceed -15."""
    points = {
        "KU Leuven Univ Box 2400": -20 + 15 + 40, "Box 12 Univ Street": -40, "ETH Zurich": 35 + 15, "CNR": 15, "CNR Institute": 2,
        "University of Universita": 80, "Dept Research Lab": -1, "Research Laboratory": -3 - 1.5, "12 Main Road": -70, "Ministero": 15 + 2 + 2, "plain": 0,
    }
    rows = spark.createDataFrame([(p,) for p in points], "part string")
    got = {r["part"]: r["score"] for r in rows.select("part", entities.part_score(F.col("part")).alias("score")).collect()}
    assert got == pytest.approx({p: x + len(p) / 100 for p, x in points.items()})
    picks = {
        "Dept Phys, KU Leuven Univ Box 2400, Belgium": "KU Leuven Univ Box 2400", "Main Street 5, Springfield": "Main Street 5", "": None, None: None,
        "Inst A College, Inst B College, X": "Inst A College", "Univ (old) Sci , Rome": "Univ Sci",
    }
    rows = spark.createDataFrame([(a,) for a in picks], "a string")
    assert {r["a"]: r["p"] for r in rows.select("a", entities.pick_institution(F.col("a")).alias("p")).collect()} == picks


def test_summary_leaves_out_documents_without_authors(spark):
    df = art(spark, [(1, 2020, 1.0, "s", ["a", "b"], []), (2, 2021, 2.0, "s", [], [])])
    row = metrics.final_summary(df, 2024).first()
    assert row["authors_per_document"] == 2.0 and row["authors"] == 2 and row["growth_pct"] == pytest.approx(0)
