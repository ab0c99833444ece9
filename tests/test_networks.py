"""Communities, components, centralities and their validation against plain versions on small networks."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from scholar_spark.operators import centrality, communities, graph, validation

EDGES = "g bigint, src string, dst string, weight bigint"


def planted(seed, n, k, inside, outside):
    rng = random.Random(seed)
    return [(f"n{i:03}", f"n{j:03}", rng.randint(1, 4)) for i, j in combinations(range(n), 2) if rng.random() < (inside if i % k == j % k else outside)]


def keyed(spark, graphs):
    return spark.createDataFrame([(g, *e) for g, edges in graphs.items() for e in edges], EDGES)


def of(df, column):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], {})[r["node"]] = r[column]
    return out


def plain_components(edges):
    root = {x: x for e in edges for x in e[:2]}
    for _ in root:
        for a, b, *_ in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_of_many_graphs(spark):
    rng = random.Random(3)
    graphs = {g: [(f"x{rng.randint(0, 60):02}", f"x{rng.randint(61, 99)}", 1) for _ in range(40)] for g in range(3)}
    graphs[7] = [(f"p{i:03}", f"p{i + 1:03}", 1) for i in range(90)]  # a long path
    graphs[8] = [("hub", f"s{i:03}", 1) for i in range(300)]
    edges = keyed(spark, graphs)
    found = communities.components(edges)
    assert of(found, "component") == {g: plain_components(e) for g, e in graphs.items()}
    sizes = communities.component_sizes(found).collect()
    for g, e in graphs.items():
        mine = sorted((r["rank"], r["size"], r["component"]) for r in sizes if r["g"] == g)
        roots = plain_components(e)
        counts = sorted(((-list(roots.values()).count(c), c) for c in set(roots.values())))
        assert mine == [(i, -n, c) for i, (n, c) in enumerate(counts, 1)]
    top = communities.largest_component(edges).where("g = 8").count()
    assert top == 300
    assert communities.components(keyed(spark, {}).limit(0)).collect() == []


def test_modularity_is_near_that_of_the_sequential_search(spark):
    graphs = {0: planted(1, 48, 4, 0.6, 0.05), 1: planted(2, 40, 3, 0.25, 0.1), 2: [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("x", "y", 9)]}
    edges = keyed(spark, graphs)
    found = communities.partitions(edges)
    values = {r["g"]: r["modularity"] for r in communities.modularity(edges, found).collect()}
    parts = of(found, "community")
    for g, e in graphs.items():
        rows = [(a, b, float(w)) for a, b, w in e]
        assert set(parts[g]) == {x for a, b, _ in e for x in (a, b)}
        assert math.isclose(values[g], graph.modularity(rows, parts[g]), abs_tol=1e-9)
        assert values[g] > graph.modularity(rows, graph.louvain(rows)) - 0.02
    ranks = of(communities.ranked(found), "community")
    assert all(sorted(set(r.values())) == list(range(len(set(r.values())))) for r in ranks.values())
    sizes = [list(ranks[0].values()).count(i) for i in range(len(set(ranks[0].values())))]
    assert sizes == sorted(sizes, reverse=True)
    alone = graph.communities(edges.where("g = 2").drop("g"))
    assert {tuple(r) for r in alone.collect()} == {("a", 0), ("b", 0), ("c", 0), ("x", 1), ("y", 1)}


def test_random_graphs_keep_degrees(spark):
    rows = planted(4, 30, 3, 0.5, 0.1)
    edges = spark.createDataFrame(rows, "src string, dst string, weight bigint")
    pairs = validation.stubs(edges, 3).collect()
    degrees = {}
    for a, b, _ in rows:
        degrees[a], degrees[b] = degrees.get(a, 0) + 1, degrees.get(b, 0) + 1
    shapes = set()
    for g in range(3):
        mine = [(r["src"], r["dst"]) for r in pairs if r["g"] == g]
        ends = [x for p in mine for x in p]
        assert {x: ends.count(x) for x in set(ends)} == degrees
        shapes.add(tuple(sorted(mine)))
    assert len(shapes) == 3
    simple = validation.null_graphs(edges, 3).collect()
    assert {(r["g"], r["src"], r["dst"]) for r in simple} == {(r["g"], r["src"], r["dst"]) for r in pairs if r["src"] != r["dst"]}


def plain_nmi(x, y):
    n = len(x)
    p = lambda v: {a: v.count(a) / n for a in set(v)}
    px, py, pxy = p(x), p(y), p(list(zip(x, y)))
    hx, hy = (-sum(q * math.log(q) for q in d.values()) for d in (px, py))
    if hx + hy < 1e-12:
        return 1.0
    return max(0.0, sum(q * math.log(q / (px[a] * py[b])) for (a, b), q in pxy.items()) / ((hx + hy) / 2))


def folds_of(seed, n, folds, gone):
    """Partitions of n nodes: g = fold, some nodes left out."""
    rng = random.Random(seed)
    home = [rng.randint(0, 3) for _ in range(n)]
    return [(f, f"n{i:02}", f"c{home[i] if rng.random() < 0.75 else rng.randint(0, 4)}") for f in range(folds) for i in range(n) if rng.random() > gone]


def linked(rows, folds, similar):
    """Average linkage, mutual nearest pairs of each round at once, on the full matrix."""
    at = {}
    for f, node, c in rows:
        at.setdefault(node, {})[f] = c
    alike = lambda a, b: sum(at[a].get(f) == c for f, c in at[b].items()) / folds
    clusters = {}
    for node in sorted(at):
        twin = next((c for c in clusters if len(at[node]) == folds and at[c] == at[node]), node)
        clusters.setdefault(twin, []).append(node)
    while True:
        mean = lambda a, b: round(sum(alike(x, y) for x in clusters[a] for y in clusters[b]) / len(clusters[a]) / len(clusters[b]), 9)
        near = {}
        for a in clusters:
            best = [(-mean(a, b), b) for b in clusters if b != a and mean(a, b) >= similar - 1e-9]
            if best:
                near[a] = min(best)[1]
        merges = [(a, b) for a, b in near.items() if a < b and near.get(b) == a]
        if not merges:
            return {x: c for c, m in clusters.items() if len(m) > 1 for x in m}
        for a, b in merges:
            clusters[a] += clusters.pop(b)


@pytest.mark.parametrize("gone", [0, 0.2])
def test_consensus_and_agreement_equal_plain_versions(spark, gone):
    rows = folds_of(5, 40, 5, gone)
    found = spark.createDataFrame(rows, "g bigint, node string, community string")
    clusters = validation.consensus(found)
    plain = linked(rows, 5, 0.6)
    assert of(clusters, "cluster").get(0, {}) == plain and len(set(plain.values())) > 1
    at = [{n: c for f, n, c in rows if f == i} for i in range(5)]
    got = {(r["i"], r["j"]): r["nmi"] for r in validation.fold_agreement(found).collect()}
    for i, j in combinations(range(5), 2):
        scope = sorted(set(at[i]) | set(at[j]))
        assert math.isclose(got[i, j], plain_nmi([at[i].get(n, "") for n in scope], [at[j].get(n, "") for n in scope]), abs_tol=1e-9)
    got = {r["f"]: r["nmi"] for r in validation.consensus_agreement(found, clusters).collect()}
    for i in range(5):
        scope = sorted(set(at[i]) & set(plain))
        assert math.isclose(got[i], plain_nmi([at[i][n] for n in scope], [plain[n] for n in scope]), abs_tol=1e-9)


def test_a_consensus_of_separate_groups(spark):
    """A gap between the similarities: any order of merging gives the two groups."""
    rows = [(f, f"{k}{i}", k if (f + i) % 5 or k == "b" else f"odd{f}{i}") for f in range(5) for k in "ab" for i in range(6)]
    got = of(validation.consensus(spark.createDataFrame(rows, "g bigint, node string, community string")), "cluster")[0]
    assert got == {f"{k}{i}": f"{k}0" for k in "ab" for i in range(6)}


def test_report_of_a_clear_structure(spark):
    rows = planted(6, 36, 3, 0.8, 0.03)
    tables = validation.validate_communities(spark.createDataFrame(rows, "src string, dst string, weight bigint"), iterations=2, folds=3)
    report = tables["report"].first()
    null = [r["nmi"] for r in tables["null"].collect()]
    assert report["comparisons"] == 3 and report["iterations"] == len(null) == 2
    assert report["folds_mean"] > 0.75 and report["p"] == 0 and report["folds_mean"] > report["null_mean"]
    assert math.isclose(report["null_sd"], np.std(null), abs_tol=1e-9) and math.isclose(report["z"], (report["folds_mean"] - np.mean(null)) / np.std(null), rel_tol=1e-6)
    assert len({r["cluster"] for r in tables["consensus"].collect()}) == 3


def test_centralities_equal_dense_ones(spark):
    graphs = {0: planted(7, 30, 2, 0.3, 0.02), 1: [("a", "b", 2), ("b", "c", 1), ("x", "y", 5)], 2: [("l", f"r{i}", 1) for i in range(4)]}
    edges = keyed(spark, graphs)
    vectors, near, degrees = of(centrality.eigenvector(edges), "eigenvector"), of(centrality.closeness(edges), "closeness"), of(centrality.degree(edges), "degree")
    for g, e in graphs.items():
        roots = plain_components(e)
        for root in set(roots.values()):
            nodes = sorted(n for n in roots if roots[n] == root)
            at = {n: i for i, n in enumerate(nodes)}
            a = np.zeros((len(nodes), len(nodes)))
            for x, y, w in e:
                if x in at:
                    a[at[x], at[y]] += w
                    a[at[y], at[x]] += w
            values, columns = np.linalg.eigh(a)
            assert np.allclose(np.abs(columns[:, -1]), [vectors[g][n] for n in nodes], atol=1e-6)
            far = np.where(a > 0, 1.0, np.inf)
            np.fill_diagonal(far, 0)
            for k in range(len(nodes)):
                far = np.minimum(far, far[:, [k]] + far[[k]])
            for n in nodes:
                total = far[at[n]].sum()
                want = (len(nodes) - 1) / total * (len(nodes) - 1) / (len(roots) - 1)
                assert math.isclose(near[g][n], want, abs_tol=1e-9)
                assert math.isclose(degrees[g][n], (a[at[n]] > 0).sum() / (len(roots) - 1), abs_tol=1e-12)


def test_fold_correlations(spark):
    rows = planted(8, 20, 2, 0.5, 0.2)
    edges = spark.createDataFrame(rows, "src string, dst string, weight bigint")
    folds = edges.select("src", "dst", validation.fold_of(5, 42).alias("f")).collect()
    assert len({r["f"] for r in folds}) == 5
    values = validation.fold_centralities(edges)
    table = {(r["f"], r["node"]): r for r in values.collect()}
    names = sorted({n for _, n in table})
    got = {r["measure"]: r for r in validation.fold_correlations(values, ("degree", "closeness", "eigenvector")).collect()}
    for m in ("degree", "closeness", "eigenvector"):
        r = np.corrcoef([[table[f, n][m] for n in names] for f in range(5)])[np.triu_indices(5, 1)]
        assert got[m]["pairs"] == 10 and math.isclose(got[m]["correlation"], r.mean(), abs_tol=1e-9)
    assert all(sum(r["f"] != f for r in folds) == keyed_count for f, keyed_count in _counts(validation.fold_graphs(edges.withColumn("g", F.lit(0).cast("long")))))


def _counts(df):
    return [(r["g"], r["count"]) for r in df.groupBy("g").count().collect()]
