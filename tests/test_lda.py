"""The term table of LDA stays on the executors: a step against plain loops, no term in the driver."""

import random
from math import exp, lgamma

import numpy as np
from pyspark.sql import functions as F

from scholar_spark.operators import lda, themes


def slope(x):
    return (lgamma(x + 1e-5) - lgamma(x - 1e-5)) / 2e-5


def plain(docs, weights, k, rate):
    """One step over all documents, word by word."""
    sums, stats = [sum(h[i] for h in weights.values()) for i in range(k)], {t: [0.0] * k for t in weights}
    beta = {t: [exp(slope(h[i]) - slope(sums[i])) for i in range(k)] for t, h in weights.items()}
    for doc in docs:
        gamma = [1.0] * k
        for _ in range(lda.ROUNDS):
            theta = [exp(slope(g) - slope(sum(gamma))) for g in gamma]
            norm = {t: sum(theta[i] * beta[t][i] for i in range(k)) for t in doc}
            after = [theta[i] * sum(beta[t][i] / norm[t] for t in doc) + 1 / k for i in range(k)]
            moved, gamma = sum(abs(a - b) for a, b in zip(after, gamma)) / k, after
            if moved <= lda.SETTLED:
                break
        theta = [exp(slope(g) - slope(sum(gamma))) for g in gamma]
        for t in doc:
            norm = sum(theta[i] * beta[t][i] for i in range(k))
            for i in range(k):
                stats[t][i] += theta[i] * beta[t][i] / norm
    return {t: [(1 - rate) * h[i] + rate * (1 / k + stats[t][i]) for i in range(k)] for t, h in weights.items()}


def test_a_step_equals_plain_loops(spark):
    rng = random.Random(5)
    docs = [rng.choices("ab cd ef gh ij kl mn op".split(), k=rng.randint(1, 12)) for _ in range(30)]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(99, [])], "id int, terms array<string>")
    first, second = (lda.fit_lda(rows, 2, n) for n in (1, 2))
    before = {r["term"]: r["h"] for r in first.weights.collect()}
    got = {r["term"]: r["h"] for r in second.weights.collect()}
    # the document without a term counts for the scale only
    rate, scale = (lda.DELAY + 2) ** -lda.FORGET, 31 / 30
    want = plain(docs, before, 2, rate)
    want = {t: [(1 - rate) * before[t][i] + rate * 0.5 + scale * (want[t][i] - (1 - rate) * before[t][i] - rate * 0.5) for i in range(2)] for t in want}
    assert got.keys() == want.keys() and all(np.allclose(got[t], want[t], rtol=1e-4) for t in want)
    mixes = {r["id"]: r["topic_mix"] for r in themes.with_topics(second, rows).collect()}
    assert mixes[99] == [0.0, 0.0] and all(abs(sum(m) - 1) < 1e-9 for i, m in mixes.items() if i != 99)
    assert 0 < second.logPerplexity(rows) < 20


def test_vocabulary_is_a_table(spark):
    docs = spark.createDataFrame([(i, f"every word{i % 4} own{i}") for i in range(40)] + [(40, None)], "id int, processed string")
    rows, vocabulary = themes.document_terms(docs)
    assert len(vocabulary) == 44 and vocabulary.table.where("term = 'every'").count() == 0
    assert rows.where(F.array_contains("terms", "every")).count() == 0 and rows.where(F.array_contains("tokens", "every")).count() == 40
    rows, vocabulary = themes.document_terms(docs, least=2.0)
    assert sorted(r["term"] for r in vocabulary.table.collect()) == [f"word{i}" for i in range(4)]
    assert {tuple(r["terms"]) for r in rows.collect()} == {(f"word{i}",) for i in range(4)} | {()}


def test_digamma():
    x = np.array([0.01, 0.3, 1.0, 4.5, 80.0])
    assert np.allclose(lda.digamma(x), [slope(v) for v in x], rtol=1e-4)
