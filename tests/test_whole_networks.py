"""Network queries do the whole of their operator's work."""

import math
import random

from scholar_spark.operators import centrality, validation
from scholar_spark.plans import catalog

SF = "/root/testdata/sf0.001"


def test_community_validation_asks_for_all_folds_and_random_graphs(spark, monkeypatch):
    asked = []

    def seen(edges, iterations=validation.ITERATIONS, folds=validation.FOLDS, seed=validation.SEED):
        asked.append((iterations, folds))
        return {"report": edges}

    monkeypatch.setattr(validation, "validate_communities", seen)
    catalog.queries()["community_validation"](spark, SF)
    assert asked == [(100, 5)]


def test_closeness_counts_whole_networks(spark, monkeypatch):
    """The query takes all ties; the exact search, over several strips and blocks, equals plain searches from each node."""
    monkeypatch.setattr(centrality, "HELD_BITS", 64 * 100)
    monkeypatch.setattr(centrality, "LOOK", 3)
    rng = random.Random(4)
    edges = {(0, i, i + 1) for i in range(110)} | {(0, *sorted(rng.sample(range(100), 2))) for _ in range(60)} | {(0, 200, 201), (0, 201, 202)}
    edges |= {(1, *sorted(rng.sample(range(90), 2))) for _ in range(900)}
    got = centrality.exact_closeness(spark.createDataFrame([(*e, 1) for e in sorted(edges)], "g bigint, src int, dst int, weight bigint"))
    got = {(r["g"], r["node"]): r["closeness"] for r in got.collect()}
    near: dict = {}
    for g, a, b in edges:
        near.setdefault((g, a), set()).add((g, b))
        near.setdefault((g, b), set()).add((g, a))
    assert set(got) == set(near)
    for node in near:
        steps, last, d = {node: 0}, {node}, 0
        while last:
            d += 1
            last = {y for x in last for y in near[x]} - set(steps)
            steps |= dict.fromkeys(last, d)
        n = len(steps) - 1
        assert math.isclose(got[node], n / sum(steps.values()) * n / (sum(x[0] == node[0] for x in near) - 1), rel_tol=1e-12)


def test_closeness_query_takes_every_tie(spark):
    authors = catalog.network(spark, SF)
    assert authors.edges.count() == authors.count * (authors.count - 1) // 2
    assert {r["closeness"] for r in catalog.queries()["network_closeness"](spark, SF).collect()} == {1.0}
