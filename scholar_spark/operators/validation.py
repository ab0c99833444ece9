"""How far communities and centralities of a network can be trusted: edge folds, consensus, random graphs.

Graphs are told apart by a column g, so folds and random graphs are rows of one table and go through each
operator together. The graph of fold f of graph g is number g * folds + f.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholar_spark.operators import communities
from scholar_spark.operators.lineage import Stored, sent
from scholar_spark.operators.metrics import zero

FOLDS, SIMILAR, ITERATIONS, SEED = 5, 0.6, 100, 42
#: Ends of a random graph that are sorted together.
RANGE = 1 << 17


def fold_of(folds: int, seed: int, ends: tuple[str, str] = ("src", "dst")) -> Column:
    """The fold of an edge, by a digest of its ends that any engine can repeat."""
    text = F.concat_ws("|", F.least(*ends), F.greatest(*ends), F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(folds))


def fold_graphs(edges: DataFrame, folds: int = FOLDS, seed: int = SEED, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """The edges of each graph but for those of one fold, for every fold; ``ends`` hold the names of numbered nodes."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    rows = edges.withColumn("fold", fold_of(folds, seed, ends)).withColumn("f", F.explode(others))
    return rows.select((F.col("g") * folds + F.col("f")).alias("g"), "src", "dst", "weight")


def shared_communities(found: DataFrame) -> DataFrame:
    """``found`` (g, node, community) without communities of one node."""
    several = found.groupBy("g", "community").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(several.drop("n"), ["g", "community"], "left_semi").select("g", "node", "community")


def mutual_information(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, nmi): normalized by the mean of both entropies; 1 where both labels, x and y, never change."""
    both = rows.groupBy(*by, "x", "y").agg(F.count("*").alias("n"))
    both = both.join(both.groupBy(*by).agg(F.sum("n").alias("t")), by).withColumn("p", F.col("n") / F.col("t")).drop("n", "t")
    px, py = both.groupBy(*by, "x").agg(F.sum("p").alias("px")), both.groupBy(*by, "y").agg(F.sum("p").alias("py"))
    entropy = lambda df, c: df.groupBy(*by).agg((-F.sum(F.col(c) * F.ln(c))).alias(f"h{c}"))
    joint = both.join(px, [*by, "x"]).join(py, [*by, "y"]).groupBy(*by).agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))
    mean = (F.col("hpx") + F.col("hpy")) / 2
    value = F.when(mean < 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("mi") / mean))
    return joint.join(entropy(px, "px"), by).join(entropy(py, "py"), by).select(*by, value.alias("nmi"))


def fold_agreement(found: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(g, i, j, nmi) for each two folds of each graph, over the nodes that one of them puts in a community.

    ``found`` are partitions of fold graphs without communities of one; a node that a fold leaves out has a
    label of its own there.
    """
    fold = F.pmod(F.col("g"), F.lit(folds))
    rows = found.select(((F.col("g") - fold) / folds).cast("long").alias("g"), fold.cast("int").alias("f"), "node", "community")
    held = rows.groupBy("g", "node").agg(F.map_from_entries(F.collect_list(F.struct("f", "community"))).alias("of"))  # at most folds entries
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(folds), 2)])
    rows = held.select("g", "of", F.explode(pairs).alias("p")).select("g", "p.i", "p.j", F.col("of")[F.col("p.i")].alias("x"), F.col("of")[F.col("p.j")].alias("y"))
    # folds without a community take no part: a pair needs labels on both sides
    some = rows.groupBy("g", "i", "j").agg(F.count("x").alias("x"), F.count("y").alias("y")).where("x > 0 AND y > 0").select("g", "i", "j")
    rows = rows.where("x IS NOT NULL OR y IS NOT NULL").join(some, ["g", "i", "j"], "left_semi").fillna("", ["x", "y"])
    return mutual_information(rows, ["g", "i", "j"])


def consensus(found: DataFrame, folds: int = FOLDS, similar: float = SIMILAR) -> DataFrame:
    """(g, node, cluster): average linkage of nodes over their folds, cut where the mean similarity falls below ``similar``.

    The similarity of two nodes is the share of the folds that put them in one community. Nodes of the same
    communities in all folds are one from the start. That of two clusters comes from how many members each has in
    each community, so no pair of nodes is written. Only clusters that agree in enough folds can pass the
    threshold: they meet on so many communities at once. In each round all pairs merge that are each other's
    nearest (of equals that of the least name); average linkage gives the same tree in any such order. Clusters
    of one node are left out; a cluster is named by its least node.
    """
    least = math.ceil(similar * folds - 1e-9)
    fold = F.pmod(F.col("g"), F.lit(folds))
    rows = found.select(((F.col("g") - fold) / folds).cast("long").alias("g"), fold.cast("int").alias("f"), "node", "community")
    held = rows.groupBy("g", "node").agg(F.sort_array(F.collect_list(F.struct("f", "community"))).alias("at"))
    whole = F.when(F.size("at") < folds, F.col("node"))  # nodes left out by a fold are not alike for sure
    names = held.groupBy("g", "at", whole.alias("alone")).agg(F.min("node").alias("cluster"), F.count("*").alias("n"))
    of = Stored(held.withColumn("alone", whole).alias("h").join(names.alias("k"), (F.col("h.g") == F.col("k.g")) & (F.col("h.at") == F.col("k.at")) & F.col("h.alone").eqNullSafe(F.col("k.alone"))).select("h.g", "node", "cluster"), "clusters")
    parts = names.select("g", "cluster", "n", F.explode("at").alias("a")).select("g", "cluster", "n", "a.f", "a.community")
    parts = Stored(parts.withColumnRenamed("n", "size").withColumn("n", F.col("size")), "parts")
    joint = F.array(*[F.when(F.size("at") > c[-1], F.array(*[F.get("at", F.lit(i)) for i in c])) for c in combinations(range(folds), least)])
    keys = names.select("g", "cluster", F.explode(joint).alias("key")).where("key IS NOT NULL")
    pairs = keys.toDF("g", "a", "key").join(keys.toDF("g", "b", "key"), ["g", "key"]).where("a < b").select("g", "a", "b").distinct()
    while True:
        ours, theirs = parts.df.toDF("g", "a", "na", "f", "community", "ha"), parts.df.toDF("g", "b", "nb", "f", "community", "hb")
        scored = pairs.join(ours, ["g", "a"]).join(theirs, ["g", "b", "f", "community"]).groupBy("g", "a", "b")
        scored = scored.agg((F.sum(F.col("ha") * F.col("hb")) / (folds * F.first("na") * F.first("nb"))).alias("similar")).where(F.col("similar") >= similar - 1e-9)
        scored = Stored(scored, "scored")
        ends = scored.df.unionByName(scored.df.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "similar"))
        near = ends.groupBy("g", "a").agg(F.min_by("b", F.struct(-F.round("similar", 9), "b")).alias("b"))
        merged = Stored(near.join(near.toDF("g", "b", "a"), ["g", "a", "b"]).where("a < b").select("g", F.col("b").alias("old"), F.col("a").alias("new")), "merged")
        if merged.df.isEmpty():
            break
        renamed = lambda df, c: df.join(merged.df.toDF("g", c, "_new"), ["g", c], "left").withColumn(c, F.coalesce("_new", c)).drop("_new")  # noqa: E731, B023
        members = renamed(of.df, "cluster").select("g", "node", "cluster")
        sizes = renamed(parts.df.select("g", "cluster", "size").distinct(), "cluster").groupBy("g", "cluster").agg(F.sum("size").alias("size"))
        sums = renamed(parts.df, "cluster").groupBy("g", "cluster", "f", "community").agg(F.sum("n").alias("n"))
        after = Stored(sums.join(sizes, ["g", "cluster"]).select("g", "cluster", "size", "f", "community", "n"), "parts")
        of_after = Stored(members, "clusters")
        both = renamed(renamed(scored.df.select("g", "a", "b"), "a"), "b")
        both = Stored(both.where("a <> b").select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        for old in (of, parts, scored, merged):
            old.drop()
        of, parts, pairs = of_after, after, both.df
    several = of.df.groupBy("g", "cluster").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return of.df.join(several, ["g", "cluster"], "left_semi").select("g", "node", "cluster")


def consensus_agreement(found: DataFrame, clusters: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(g, f, nmi) of each fold's partition and the consensus, over the nodes that both have."""
    fold = F.pmod(F.col("g"), F.lit(folds))
    rows = found.select(((F.col("g") - fold) / folds).cast("long").alias("g"), fold.cast("int").alias("f"), "node", F.col("community").alias("x"))
    return mutual_information(rows.join(clusters.withColumnRenamed("cluster", "y"), ["g", "node"]), ["g", "f"])


def stubs(edges: DataFrame, iterations: int, seed: int = SEED) -> DataFrame:
    """(g, src, dst): random pairs of edge ends, as many at each node as it has edges, for each iteration.

    Loops and parallel pairs stand as they fall. Ends lie in random order, by hash; neighbours pair. The first
    bits of the hash make ranges of even size, so no task holds an iteration; a range's ends are paired where they
    are sorted, but for one that its last or first end may leave to the next. ``edges`` (src, dst) are those of
    one simple graph.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    ends = Stored(ends, "ends").df
    bits = min(24, math.ceil(math.log2(max((ends.agg(F.sum("degree")).first()[0] or 0) / RANGE, 2))))
    copies = ends.select("node", F.explode(F.sequence(F.lit(1), F.col("degree"))).alias("k"))
    copies = copies.select(F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("g"), "node", "k")
    copies = copies.select("g", "node", F.xxhash64("g", "node", "k", F.lit(seed)).alias("_key"))
    copies = copies.withColumn("_range", F.shiftright("_key", 64 - bits))
    before = Window.partitionBy("g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = copies.groupBy("g", "_range").agg(F.count("*").alias("n")).select("g", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("g", "_range").orderBy("_key", "node")
    placed = copies.withColumns({"place": F.row_number().over(order), "next": F.lead("node").over(order)})
    placed = placed.join(sent(starts, iterations << bits), ["g", "_range"]).withColumn("position", F.col("start") + F.col("place") - 1)
    placed = placed.where("position % 2 = 0 OR place = 1")
    pair = F.when(F.col("next").isNull() | (F.col("position") % 2 == 1), F.floor(F.col("position") / 2))  # of an end whose fellow is in another range
    made = Stored(placed.select("g", F.col("node").alias("x"), F.when(pair.isNull(), F.col("next")).alias("y"), pair.alias("pair")), "stubs").df
    # the fellow of a first end is the last one of a range before
    apart = made.where("pair IS NOT NULL").groupBy("g", "pair").agg(F.min("x").alias("x"), F.max("x").alias("y"))
    pairs = made.where("pair IS NULL").select("g", "x", "y").unionByName(apart.select("g", "x", "y"))
    return pairs.select("g", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))


def null_graphs(edges: DataFrame, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """(g, src, dst, weight 1): random simple graphs from ``stubs``, loops dropped and parallel edges taken once."""
    return stubs(edges, iterations, seed).where("src <> dst").distinct().withColumn("weight", F.lit(1))


def validate_communities(edges: DataFrame, iterations: int = ITERATIONS, folds: int = FOLDS, seed: int = SEED) -> dict[str, DataFrame]:
    """Tables about the communities of one network (src, dst, weight).

    consensus (node, cluster; clusters of one left out); agreement (kind, i, j, nmi) of folds with each other and
    with the consensus; null (g, nmi) of random graphs of the same degrees, those with fewer than two partitions left out;
    report (one row): means and standard deviations of both, of the random graphs, p (share of those that agree as well)
    and z. The network, as graph 0, and the random graphs go through the same rounds of the community search.
    """
    edges = Stored(edges, "network").df
    graphs = edges.select(F.lit(0).cast("long").alias("g"), "src", "dst", "weight")
    random = null_graphs(edges, iterations, seed).select((F.col("g") + 1).cast("long").alias("g"), "src", "dst", F.col("weight").cast(edges.schema["weight"].dataType).alias("weight"))
    parts = Stored(fold_graphs(graphs.unionByName(random), folds, seed), "folds")
    found = Stored(shared_communities(communities.partitions(parts.df)), "found").df
    parts.drop()
    own, others = found.where(F.col("g") < folds), found.where(F.col("g") >= folds)
    clusters = Stored(consensus(own, folds), "consensus").df
    folds_nmi = fold_agreement(own, folds).select(F.lit("folds").alias("kind"), "i", "j", "nmi")
    agreed = consensus_agreement(own, clusters, folds).select(F.lit("consensus").alias("kind"), F.col("f").alias("i"), F.lit(None).cast("int").alias("j"), "nmi")
    agreement = Stored(folds_nmi.unionByName(agreed), "agreement").df
    null = fold_agreement(others, folds).groupBy("g").agg(F.avg("nmi").alias("nmi"))
    null = Stored(null.select((F.col("g") - 1).alias("g"), "nmi"), "null").df
    return {"consensus": clusters.drop("g"), "agreement": agreement, "null": null, "report": validation_report(agreement, null)}


def validation_report(agreement: DataFrame, null: DataFrame) -> DataFrame:
    """One row from ``agreement`` (kind, nmi) and ``null`` (nmi); deviations are of the population, z is null where it is 0."""
    mine = lambda kind: F.when(F.col("kind") == kind, F.col("nmi"))
    seen = agreement.agg(
        *[f(mine(k)).alias(f"{k}_{n}") for k in ("folds", "consensus") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))], F.count(mine("folds")).alias("comparisons")
    )
    rows = null.join(F.broadcast(seen.select(F.col("folds_mean").alias("seen"))), F.lit(True), "left")  # one row
    random = rows.agg(F.count("nmi").alias("iterations"), F.avg("nmi").alias("null_mean"), F.stddev_pop("nmi").alias("null_sd"), F.avg((F.col("nmi") >= F.col("seen")).cast("int")).alias("p"))
    both = seen.join(random, F.lit(True))  # one row each
    return both.withColumn("z", F.when(F.col("null_sd") > 1e-9, (F.col("folds_mean") - F.col("null_mean")) / F.col("null_sd")))


def fold_centralities(edges: DataFrame, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """(f, node, degree, closeness, eigenvector) in each fold's graph; a node without an edge in it has zeros."""
    from scholar_spark.operators import centrality

    own = Stored(fold_graphs(edges.select(F.lit(0).cast("long").alias("g"), "src", "dst", "weight"), folds, seed), "folds").df
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    every = nodes.select(F.explode(F.expr(f"sequence(0L, {folds - 1}L)")).alias("g"), "node")
    out = every
    for found in (centrality.degree(own), centrality.closeness(own), centrality.eigenvector(own)):
        out = out.join(found, ["g", "node"], "left")
    return out.select(F.col("g").cast("int").alias("f"), "node", *[zero(F.col(c)).cast("double").alias(c) for c in ("degree", "closeness", "eigenvector")])


def fold_correlations(values: DataFrame, measures: tuple[str, ...], folds: int = FOLDS) -> DataFrame:
    """(measure, correlation, pairs): the mean correlation over nodes of each two folds; constant folds take no part."""
    wide = values.groupBy("node").agg(*[F.max(F.when(F.col("f") == f, F.col(m))).alias(f"{m}_{f}") for m in measures for f in range(folds)])
    pairs = list(combinations(range(folds), 2))
    row = wide.agg(*[F.corr(f"{m}_{i}", f"{m}_{j}").alias(f"{m}_{i}_{j}") for m in measures for i, j in pairs])
    listed = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_{i}_{j}").alias("r")) for m in measures for i, j in pairs])
    rows = row.select(F.explode(listed).alias("x")).select("x.measure", F.when(~F.isnan("x.r"), F.col("x.r")).alias("r"))
    return rows.groupBy("measure").agg(F.avg("r").alias("correlation"), F.count("r").alias("pairs"))


