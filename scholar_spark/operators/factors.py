"""Factors of a large sparse table: a randomised truncated SVD, the start that it gives, and non-negative factors.

The table X is (id, term, tf), one row a cell that is not zero. A factor is (id or term, f), an array for each row.
Only Gram matrices as wide as the factors reach the driver; factors are written in each step and the step before
is deleted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholar_spark.operators.lineage import Stored

#: Columns of the random range beyond those asked for, and times that it is multiplied by the table and back.
WIDER, ROUNDS = 10, 4
#: Most bytes of a factor that is sent to all executors; beyond it a shuffle join does the same.
SENT_BYTES = 64 << 20
#: Cells of a start below it count as zero.
LEAST = 1e-6


class Cells:
    """X written once for each side, dealt by it, so that a side's sums are made where its cells lie."""

    def __init__(self, cells: DataFrame):
        x = cells.select("id", "term", F.col("tf").cast("double").alias("tf")).where("tf <> 0").repartition("id")
        self.stored = {"id": Stored(x, "cells")}
        self.x = self.stored["id"].df
        self.stored["term"] = Stored(self.x.repartition("term"), "cells")
        key = {c: self.x.select(c).distinct().agg(F.count("*"), F.sum(F.octet_length(F.col(c).cast("string")))).first() for c in ("id", "term")}
        self.size = {c: n for c, (n, _) in key.items()}
        self.bytes = {c: (b or 0) + 32 * n for c, (n, b) in key.items()}
        self.total, self.square = (v or 0.0 for v in self.x.agg(F.sum("tf"), F.sum(F.col("tf") * F.col("tf"))).first())

    def drop(self) -> None:
        for stored in self.stored.values():
            stored.drop()

    def keys(self, side: str) -> DataFrame:
        return self.stored[side].df.select(side).distinct()

    def times(self, f: DataFrame, side: str, other: str, width: int) -> DataFrame:
        """(side, f): X, or for terms its transpose, times the factor of the other side."""
        small = self.bytes[other] + 8 * width * self.size[other] <= SENT_BYTES
        met = self.stored[side].df.join(F.broadcast(f) if small else f, other)  # its size is counted
        sums = met.groupBy(side).agg(*[F.expr(f"sum(tf * f[{i}])").alias(f"n{i}") for i in range(width)])
        return sums.select(side, F.array(*[f"n{i}" for i in range(width)]).alias("f"))


def gram(f: DataFrame, width: int, met: bool = False) -> np.ndarray | tuple[np.ndarray, float]:
    """f'f: a row of it for each place of the array, summed before the shuffle; with ``met`` also the sum of f times n."""
    sums, out, total = [F.expr(f"sum(a * f[{j}])") for j in range(width)], np.zeros((width, width)), 0.0
    if met:
        sums.append(F.expr("sum(a * n[i])"))
    for row in f.select("*", F.posexplode("f").alias("i", "a")).groupBy("i").agg(*sums).collect():  # width rows
        out[row[0]] = row[1 : width + 1]
        total += row[-1]
    out = (out + out.T) / 2
    return (out, total) if met else out


def turned(f: DataFrame, side: str, m: np.ndarray) -> DataFrame:
    """Each row of a factor times the matrix ``m``."""
    columns = ", ".join(f"array({', '.join(f'{float(x)!r}D' for x in column)})" for column in m.T)
    return f.select(side, F.expr(f"transform(array({columns}), m -> aggregate(zip_with(f, m, (a, b) -> a * b), 0D, (s, x) -> s + x))").alias("f"))


def _next(before: Stored | None, df: DataFrame, tag: str) -> Stored:
    after = Stored(df, tag)
    if before is not None:
        before.drop()
    return after


def _orthonormal(f: Stored, side: str, width: int) -> tuple[Stored, int]:
    """Columns of length 1 at right angles that span the same; fewer where the columns depend on one another."""
    values, vectors = np.linalg.eigh(gram(f.df, width))
    held = values > max(values.max(), 0.0) * 1e-12
    return _next(f, turned(f.df, side, vectors[:, held] / np.sqrt(values[held])), "range"), int(held.sum())


def truncated_svd(cells: Cells, k: int, seed: int = 42, wider: int = WIDER, rounds: int = ROUNDS) -> tuple[Stored, np.ndarray, Stored]:
    """(u by id, singular values from the largest, v by term): at most ``k`` of each, fewer if X has a lower rank.

    A random range of k + ``wider`` columns is multiplied by X and its transpose ``rounds`` times; signs by the
    hash of a term stand for random numbers, so every run starts alike.
    """
    width = k + wider
    signs = [2.0 * F.pmod(F.xxhash64("term", F.lit(seed), F.lit(i)), F.lit(2)) - 1 for i in range(width)]
    q = Stored(cells.times(cells.keys("term").select("term", F.array(*signs).alias("f")), "id", "term", width), "range")
    q, width = _orthonormal(q, "id", width)
    for _ in range(rounds):
        for side, other in (("term", "id"), ("id", "term")):
            q, width = _orthonormal(_next(q, cells.times(q.df, side, other, width), "range"), side, width)
    b = Stored(cells.times(q.df, "term", "id", width), "range")
    values, vectors = np.linalg.eigh(gram(b.df, width))
    first = [i for i in np.argsort(values)[::-1][:k] if values[i] > max(values.max(), 0.0) * 1e-12]
    s, m = np.sqrt(values[first]), vectors[:, first]
    return _next(q, turned(q.df, "id", m), "left"), s, _next(b, turned(b.df, "term", m / s), "right")


def svd_start(cells: Cells, k: int, seed: int = 42) -> tuple[Stored, Stored]:
    """The start of non-negative factors from the SVD: of each pair of singular vectors the positive or the negative
    parts, whichever weigh more, and the table's mean where those are zero."""
    u, s, v = truncated_svd(cells, k, seed)
    mean, rank = cells.total / (cells.size["id"] * cells.size["term"]), len(s)
    above = lambda i, sign: F.sum(F.pow(F.greatest(sign * F.col("f")[i], F.lit(0.0)), F.lit(2)))
    long = [np.sqrt([w or 0.0 for w in f.df.agg(*[above(i, sign) for i in range(rank) for sign in (1, -1)]).first()]).reshape(rank, 2) for f in (u, v)]
    weight = long[0] * long[1]
    side = np.where(weight[:, 0] > weight[:, 1], 0, 1)

    def made(f: DataFrame, key: str, lengths: np.ndarray) -> DataFrame:
        out = [F.abs(F.col("f")[0]) * float(np.sqrt(s[0]))]
        for i in range(1, rank):
            scale = np.sqrt(s[i] * weight[i, side[i]]) / lengths[i, side[i]] if weight[i, side[i]] > 0 else 0.0
            out.append(F.col("f")[i] * float((1, -1)[side[i]] * scale))
        filled = [F.when(c >= LEAST, c).otherwise(F.lit(mean)) for c in out] + [F.lit(mean)] * (k - rank)
        return f.select(key, F.array(*filled).alias("f"))

    return _next(u, made(u.df, "id", long[0]), "factor"), _next(v, made(v.df, "term", long[1]), "factor")


def random_start(cells: Cells, k: int, seed: int = 42) -> tuple[Stored, Stored]:
    draw = lambda key: F.array(*[F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(1_000_003)) / 1_000_003.0 + 0.01 for i in range(k)])
    return tuple(Stored(cells.keys(key).select(key, draw(key).alias("f")), "factor") for key in ("id", "term"))


STARTS = {"svd": svd_start, "random": random_start}


def fit_nmf(doc_terms: DataFrame, k: int, iterations: int = 500, seed: int = 42, tolerance: float = 1e-4, start: str = "svd") -> tuple[DataFrame, DataFrame, list[float]]:
    """Non-negative factors by multiplicative updates: (id, w array), (term, h array), squared losses of each round.

    doc_terms has id, term, tf of 0 or more, each cell once. Rounds end when a round takes off less than
    ``tolerance`` of the first loss. A round writes both factors; its loss comes from the sums that the last update
    was made of. A table without a cell has no factors, and a loss of 0. The start from the
    SVD is the same on every run; it mostly ends at a lower loss than random ones, but not on every table.
    """
    cells = Cells(doc_terms)
    if not cells.total:
        none = F.lit(None).cast("array<double>")
        return cells.keys("id").withColumn("w", none), cells.keys("term").withColumn("h", none), [0.0]

    def update(f: Stored, key: str, other: str, g: Stored, m: np.ndarray) -> Stored:
        """f * (X g) / (f m), where m = g'g; keeps X g as n."""
        sums = cells.times(g.df.select(other, "f"), key, other, k).toDF(key, "n")
        below = turned(f.df.select(F.struct(key, "f").alias("row"), "f"), "row", m).select("row.*", F.col("f").alias("b")).toDF(key, "f", "b")
        new = F.expr("transform(f, (x, i) -> x * n[i] / (b[i] + 1e-12D))")
        return _next(f, below.join(sums, key).select(key, new.alias("f"), "n"), "factor")

    w, h = STARTS[start](cells, k, seed)
    losses, of_h = [], gram(h.df, k)
    for _ in range(iterations):
        w = update(w, "id", "term", h, of_h)
        of_w = gram(w.df, k)
        h = update(h, "term", "id", w, of_w)
        of_h, both = gram(h.df, k, True)
        losses.append(float(cells.square - 2 * both + (of_w * of_h).sum()))
        if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * max(losses[0], 1e-12):
            break
    cells.drop()
    return w.df.select("id", F.col("f").alias("w")), h.df.select("term", F.col("f").alias("h")), losses
