import math
import random

import pytest
from scholar_spark.functions import text as X
from scholar_spark.operators import metrics, themes


def plain(topics, docs, size):
    """c_v by looking at every window."""
    windows = [set(d[i : i + size]) for d in docs for i in range(max(1, len(d) - size + 1))]
    p = lambda *t: sum(set(t) <= w for w in windows) / len(windows)
    out = {}
    for topic, terms in topics.items():
        vectors = [[math.log((p(x, y) + 1e-12) / (p(x) * p(y))) / -math.log(p(x, y) + 1e-12) for y in terms] for x in terms]
        whole = [sum(c) for c in zip(*vectors)]
        norm = lambda v: math.sqrt(sum(c * c for c in v))
        out[topic] = sum(sum(a * b for a, b in zip(v, whole)) / norm(v) / norm(whole) for v in vectors) / len(vectors)
    return out


@pytest.mark.parametrize("size", [3, 64, 110])
def test_cv_equals_all_windows(spark, size):
    rng = random.Random(size)
    docs = [[rng.choice("abcdefghij") if rng.random() < 0.2 else f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 5, 60, 109, 110, 111, 150, 400]))] for _ in range(30)]
    topics = {1: list("abcd"), 2: list("efg"), 3: list("ahij")}
    df = spark.createDataFrame(list(enumerate(docs)), "id bigint, tokens array<string>")
    terms = spark.createDataFrame([(t, x) for t, xs in topics.items() for x in xs], "topic int, term string")
    got = {r["topic"]: r["coherence"] for r in themes.cv_coherence(terms, df, size).collect()}
    want = plain(topics, docs, size)
    assert got == pytest.approx(want, abs=1e-9)


def test_titles_and_authors_in_rankings(spark):
    rows = [(1, 5, "t" * 70, ["A", "B"]), (2, 9, "t" * 71, []), (3, None, None, ["C"])]
    df = spark.createDataFrame(rows, "id bigint, cites bigint, Title string, authors array<string>")
    got = [(r["rank"], r["id"], r["short_title"], r["first_author"]) for r in metrics.article_ranking(df, 3).collect()]
    assert got == [(1, 2, "t" * 70 + "...", "N/A"), (2, 1, "t" * 70, "A"), (3, 3, None, "C")]
    assert [(r["rank"], r["id"]) for r in metrics.article_ranks(df).orderBy("rank").collect()] == [(1, 2), (2, 1), (3, 3)]
    spelled = spark.createDataFrame([("k", 2000, s) for s in ["THE LANCET", "the lancet", "The Lancet", "the lancet", None]] + [("q", 2000, "x" * 45)], "source string, year int, title string")
    titles = {r["source"]: (r["title"], r["display"]) for r in metrics.source_titles(spelled, "title").collect()}
    assert titles["k"] == ("The Lancet", "The Lancet") and titles["q"][1].endswith("...") and len(titles["q"][1]) == 43
    assert df.select(X.truncate(df["Title"], 70).alias("x")).where("id = 1").first()["x"] == "t" * 70
