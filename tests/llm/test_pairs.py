"""Operators on pairs against brute force."""

import random
from itertools import combinations

import pytest
from scholar_spark.llm import jaccard
from scholar_spark.llm.common import connected_components


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_texts(seed=5):
    """Bases of many sizes with copies that differ in 0 to 8 words, exact copies, short and odd texts."""
    rng = random.Random(seed)
    rows = []
    for size in (1, 3, 5, 6, 8, 9, 10, 12, 19, 20, 21, 24, 30, 45, 63, 64, 68, 80, 100, 130, 160, 300, 700):
        base = words(rng, size)
        for k in range(7):
            own = list(base)
            for _ in range(k):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            if k % 3 == 2:
                own = own + words(rng, 1 + size // 30)
            rows.append(" ".join(own))
        rows.append(" ".join(base).upper() + " ")
    common = words(rng, 12)
    rows += [" ".join(words(rng, 6) + common + words(rng, 6)) for _ in range(40)]
    return rows + [None, "", " \t\n", rows[-1], rows[-1]]


def shingles(text):
    own = (text or "").encode().lower().split()
    n = min(5, len(own))
    return frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if own else frozenset()


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_jaccard(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return {(i, len(sets[i]), c) for i, c in enumerate(components(len(sets), links))}, len(links)


def test_ngram_jaccard_equals_brute_force(spark):
    texts = near_texts()
    want, links = brute_jaccard(texts)
    assert links > 100
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, set bigint, key string")
    got = {tuple(r) for r in jaccard.link_documents(docs.repartition(5)).collect()}
    assert got == want


def test_ngram_jaccard_of_a_large_group_of_chains(spark):
    """Copies that each differ from the next in one word: many links, none to the first."""
    rng = random.Random(9)
    own = words(rng, 60)
    texts = []
    for i in range(80):
        own = list(own)
        own[(7 * i) % 60] = f"y{i}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    want, _ = brute_jaccard(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {tuple(r) for r in jaccard.link_documents(docs).collect()} == want


def test_ngram_jaccard_edge_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.link_documents(docs).count() == 0
    rows = [(None, "a b c d e f"), (4, "A b c d e f"), (4, "a b c d e f"), (4, "other words altogether in this text"), (None, None)]
    got = sorted((tuple(r) for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None)], key=str)


def test_every_linked_pair_shares_a_key():
    import numpy as np

    rng = np.random.default_rng(1)
    for size in [*range(4, 80), 95, 127, 128, 160, 161, 400, 1001]:
        d = jaccard.most_apart(size)
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            extra = np.unique(rng.integers(0, 2**64, d, dtype=np.uint64))
            b = np.unique(np.concatenate([a, extra]))
            assert jaccard.links(a, b)
            assert set(jaccard.block_keys(a).tolist()) & set(jaccard.block_keys(b).tolist()), size
            assert jaccard.may_link(len(a), jaccard.parity_sketch(a), len(b), jaccard.parity_sketch(b))


@pytest.mark.parametrize("native", [False, True])
def test_components(spark, native):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    want = components(500, links)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint"), native=native).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
