"""Topic and n-gram tables against plain versions, and plans that grow with what documents hold."""

import math
import random
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from scholar_spark.operators import grams, themes


def test_umass_equals_all_pairs_and_lists_only_pairs_in_documents(spark):
    rng = random.Random(6)
    docs = {i: {f"t{rng.randrange(25):02}" for _ in range(5)} for i in range(40)}
    topics = [(k, rng.randrange(12), f"t{rng.randrange(30):02}") for k in range(3) for _ in range(14)]  # ties, repeats, unseen terms
    want = []
    for k in range(3):
        mine = [t for t in topics if t[0] == k]
        for (_, rx, x), (_, ry, y) in combinations(mine, 2):
            if rx != ry:
                early = y if rx > ry else x
                both = sum(x in d and y in d for d in docs.values()) if x != y else 0
                want.append(math.log((both + 1) / max(1, sum(early in d for d in docs.values()))))
    terms = spark.createDataFrame(topics, "topic int, rank int, term string")
    held = spark.createDataFrame([(i, t) for i, d in docs.items() for t in d], "id bigint, term string")
    got = themes.umass_coherence(terms, held)
    assert got.first()["coherence"] == pytest.approx(sum(want) / len(want), abs=1e-9)
    nothing = themes.umass_coherence(terms.limit(0), held)
    assert [r["coherence"] for r in nothing.collect()] == [None]


def test_counted_ngrams_equal_all_counts_cut_afterwards(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", f"x{rng.randrange(99)}"]) for _ in range(12))) for i in range(60)], "id bigint, text string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = themes.ngrams(docs).where((F.col("df") >= 5) & (F.col("df") <= 54))
    assert rows(themes.counted_ngrams(docs)) == rows(want) and want.count() > 20


def test_noise_words_are_searched_as_a_set(spark):
    df = spark.createDataFrame([("the studies of graphs and the graph",), (None,)], "text string")
    out = df.select(themes.processed(F.col("text"), themes.noise_terms()).alias("p"))
    assert [r["p"] for r in out.collect()][0].split() == ["graph", "graph"] or "graph graph" in out.first()["p"]
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_grams_are_counted_in_tasks_or_joined_beyond_a_bound(spark, monkeypatch):
    """Both ways, with documents of one token and none, words beyond ASCII."""
    rng = random.Random(9)
    pool = ["aa", "b-b", "çé", "dd", "ßß", "e_"]
    texts = [" ".join(rng.choice([*pool, f"x{rng.randrange(40)}"]) for _ in range(rng.choice((0, 1, 2, 5, 30)))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "aa " * 300])], "id bigint, text string").repartition(3)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(themes.ngrams(docs).where("df >= 3 AND df <= 0.9 * 202"))
    assert {r[1] for r in want} == {1, 2, 3, 4}
    assert rows(themes.counted_ngrams(docs, 3)) == want
    monkeypatch.setattr(themes, "SENT_ROWS", 30)
    assert rows(themes.counted_ngrams(docs, 3)) == want
    monkeypatch.setattr(themes, "SENT_ROWS", 0)
    assert rows(themes.counted_ngrams(docs, 3)) == want
    assert themes.counted_ngrams(docs.limit(0), 3).count() == 0


def test_chunks_hold_whole_documents_and_all_of_them(monkeypatch):
    monkeypatch.setattr(grams, "CHUNK", 5)
    lists = [["a", "b"], ["a"] * 9, ["c"], ["a", "c"], ["b", "b"], ["a"] * 5]
    batch = pa.RecordBatch.from_arrays([pa.array([["z"], *lists])], names=["w"]).slice(1)
    chunks = [(t.to_pylist(), d.tolist()) for t, d in grams._chunks(iter([batch]))]
    assert sum((t for t, _ in chunks), []) == sum(lists, [])
    assert [d for _, d in chunks] == [[0, 0], [0] * 9, [0, 1, 1, 2, 2], [0] * 5]
    got = [x for b in grams._words(iter([batch])) for x in b.to_pylist() if x["w1"] == "a"]
    assert (sum(x["total"] for x in got), sum(x["df"] for x in got)) == (16, 4)
