import hashlib
import math

import numpy as np
import pytest
from scholar_spark.llm import queries
from scholar_spark.llm.vectors import Codebook, compress_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string"


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) by exact distances to all entries."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    x = np.array([[math.floor(1024 * float(np.float32(c))) for c in r[1]] for r in good], np.int64)
    first = np.argsort([r[0] for r in good], kind="stable")[:entries]
    books = [b.copy() for b in np.split(x[first], parts, axis=1)]
    cut = np.split(x, parts, axis=1)

    def assign():
        far = [((v[:, None, :] - b[None]) ** 2).sum(2) for v, b in zip(cut, books)]
        return [d.argmin(1) for d in far], [d.min(1) for d in far]

    for _ in range(rounds):
        index, _ = assign()
        for v, b, i in zip(cut, books, index):
            for e in set(i.tolist()):
                b[e] = v[i == e].sum(0) // (i == e).sum()
    index, error = assign()
    error, of = sum(error), {}
    for r, e in zip(good, error):
        of[r[2]] = of.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    return sorted((r[0], "".join(f"{i[k]:02x}" for i in index), int(error[k]), of[r[2]], sha) for k, r in enumerate(good))


def result(df):
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.mark.parametrize("m", [1, 2, 3, 4, 7, 16, 33])
def test_nearest_equals_a_full_search(m):
    rng = np.random.default_rng(m)
    for spread in (2, 50, 30_000):
        e, x = rng.integers(-spread, spread, (97, m)), rng.integers(-spread, spread, (500, m))
        e[50], x[:9], x[9] = e[3], e[50], 0
        far = ((x[:, None] - e[None]) ** 2).sum(2)
        index, error = Codebook(e).nearest(x)
        assert index.tolist() == far.argmin(1).tolist() and error.tolist() == far.min(1).tolist()


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 7 % 701, rng.normal(size=16).astype(np.float32).tolist(), int(i % 5) or None, "clash") for i in range(701)]
    rows += [(1000 + i, rows[0][1], 3, None) for i in range(300)]  # a third are copies
    odd = [(2000, None, 1, None), (-1, [1.0, None] * 8, 1, None), (-2, [math.nan] * 16, 1, None), (-3, [math.inf] * 16, None, None)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(7)
    assert result(compress_vectors(df)) == brute(rows)
    few = rows[:40]  # fewer vectors than entries
    assert result(compress_vectors(spark.createDataFrame(few, SCHEMA))) == brute(few)


def test_odd_tables(spark):
    assert compress_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert compress_vectors(spark.createDataFrame([(1, None, 2, "")], SCHEMA)).collect() == []
    v = [0.5] * 8
    rows = [(3, v, None, ""), (3, v, None, ""), (None, v, 1, ""), (4, [1.0] * 4, 1, ""), (2, [1.0] * 3, 1, ""), (9, [], 1, "")]
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in compress_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(3, "00000000", 0, 0), (3, "00000000", 0, 0), (None, "00000000", 0, 0), (4, None, None, 0), (2, None, None, 0), (9, None, None, 0)], key=str)
    # a repeated key begins one entry, with its least vector
    rows = [(1, [2.0] * 4, 1, ""), (1, [1.0] * 4, 1, ""), (5, [4.0] * 4, 1, "")]
    got = sorted(tuple(r)[::2][:2] for r in compress_vectors(spark.createDataFrame(rows, SCHEMA), entries=2).select("vec_id", "label", "code").collect())
    assert got == [(1, "00000000"), (1, "00000000"), (5, "01010101")]
    with pytest.raises(Exception, match="too large"):
        compress_vectors(spark.createDataFrame([(1, [1e9] * 4, 1, "")], SCHEMA)).collect()


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(queries.op12_vector_codes(spark, sf)) == brute(rows)
