"""Operator 12: vector code compression with conservative segment-mean bounds.

A vector is cut into equal parts; each part is replaced by the index of the nearest entry of its position's
codebook. For a part v and an entry e cut into blocks of m components,

    |v - e|^2  >=  sum over blocks of  m (mean v - mean e)^2 + (|rest v| - |rest e|)^2

where rest is what remains of a block without its mean. One block comes first, then finer ones; an entry
falls out once its bound exceeds the exact distance to the entry of a level's least bound. What survives gets
exact integer distances, so the result is that of a search through all entries.

Assignment runs in tasks over Arrow batches. A task adds up what it assigned and hands over one sum for each
component of each entry, so a shuffle carries sums, never vectors; the driver holds the codebooks alone, whose
size is set by parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, sent

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose bounds are taken at once: rows x entries doubles.
CHUNK = 512


class Codebook:
    """The entries of one part position, with the points that their bounds are taken from at each level."""

    def __init__(self, entries: np.ndarray):
        self.entries, (self.n, self.m) = entries, entries.shape
        blocks = sorted({1, min(4, self.m), (self.m + 1) // 2})
        self.levels = [np.linspace(0, self.m, b + 1).astype(int)[:-1] for b in blocks if b]
        self.points = [self.point(entries, starts) for starts in self.levels]
        self.norm = float((entries.astype(float) ** 2).sum(1).max(initial=0))

    def point(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The blocks' means times the root of their size, then the norms of what remains (its square is exact
        before it is divided): squared distances of such points are the bounds."""
        size = np.diff(np.append(starts, self.m))
        sums = np.add.reduceat(x, starts, axis=1)
        rest = np.add.reduceat(x * x, starts, axis=1) * size - sums * sums
        return np.hstack([sums / np.sqrt(size), np.sqrt(rest / size)])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the index of its nearest entry (the lowest of equals) and the squared distance."""
        if not self.m:  # parts without components are all alike
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        reach = 2 * (int(np.abs(x).max(initial=0)) + int(np.abs(self.entries).max(initial=0)))
        if reach * reach * self.m * self.m >= 1 << 62:
            raise OverflowError("components are too large for exact squared distances in 64 bits")
        index, error = [], []
        for i in range(0, len(x), CHUNK):
            a, b = self._nearest(x[i : i + CHUNK])
            index.append(a)
            error.append(b)
        return np.concatenate(index), np.concatenate(error)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(x))
        norm = (x.astype(float) ** 2).sum(1)
        slack = 1e-9 * (norm + self.norm)  # far more than rounding moves a bound
        limit, alive = np.full(len(x), np.inf), np.ones((len(x), self.n), bool)
        for starts, points in zip(self.levels, self.points):
            own = self.point(x, starts)
            bound = (points**2).sum(1) - 2 * own @ points.T
            bound += (own**2).sum(1)[:, None]
            first = np.where(alive, bound, np.inf).argmin(1)
            limit = np.minimum(limit, ((x - self.entries[first]) ** 2).sum(1))
            alive &= bound <= (limit + slack)[:, None]
        row, entry = np.nonzero(alive)
        exact = ((x[row] - self.entries[entry]) ** 2).sum(1)
        error = np.minimum.reduceat(exact, np.searchsorted(row, every))
        best = np.flatnonzero(exact == error[row])
        return entry[best[np.searchsorted(row[best], every)]], error


def _assign(books: list[Codebook], batch: pa.RecordBatch):
    """The batch's vectors as integers in parts, with the index and the distance of each part's entry."""
    column = batch.column(batch.schema.get_field_index("v"))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(SCALE * flat)
    if np.abs(whole).max(initial=0) >= 1 << 31:
        raise OverflowError("components are too large for exact squared distances in 64 bits")
    parts = whole.astype(np.int64).reshape(batch.num_rows, len(books), books[0].m)
    for p, book in enumerate(books):
        yield parts[:, p], *book.nearest(parts[:, p])


def _sums(books: list[np.ndarray]):
    """A function from batches to (slot, total): the sums of components, and the numbers, of each entry's parts."""
    n, m = books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros((len(books), n, m + 1), np.int64), [Codebook(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                for p, (x, index, _) in enumerate(_assign(own, batch)):
                    order = np.argsort(index, kind="stable")
                    used, begins, number = np.unique(index[order], return_index=True, return_counts=True)
                    total[p, used, :m] += np.add.reduceat(x[order], begins)
                    total[p, used, m] += number
        used = np.flatnonzero(np.repeat(total[:, :, m].ravel() > 0, m + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], names=["slot", "total"])

    return run


def train_codebooks(vectors: DataFrame, first: np.ndarray, parts: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after ``rounds`` of assigning and averaging; ``vectors`` has a column v, ``first`` the first entries' integers."""
    books = [np.ascontiguousarray(x) for x in np.split(first, parts, axis=1)]
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(_sums(books), "slot bigint, total bigint").groupBy("slot").agg(F.sum("total").alias("total"))
        found = np.zeros((parts, len(first), books[0].shape[1] + 1), np.int64)
        for slot, total in sums.collect():  # at most parts x entries x (components + 1) rows
            found.ravel()[slot] = total
        number = found[:, :, -1:]
        books = [np.where(k > 0, s // np.maximum(k, 1), b) for s, k, b in zip(found[:, :, :-1], number, books)]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def kept_vectors(table: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there and holds finite components only."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col(vector).isNotNull() & F.coalesce(plain, F.lit(False)))


def compress_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """Codes of ``parts`` indices for every vector, from codebooks learned on all of them.

    Returns key, label, code (two hexadecimal digits a part, so ``entries`` is at most 256), error (squared
    distances to the entries, in integer components floor(1024 x)), label_error (the errors of equal labels
    added up, nulls together) and codebooks_sha256. Vectors that are null or hold null, NaN or infinite
    components are left out. The ``entries`` smallest keys begin the codebooks; of rows with one key the least
    vector does, null keys don't. The length is that of the smallest key whose vector has one that ``parts``
    divides; vectors of other lengths stay, with null code and error. Repeated rows and null keys give a row
    each, other columns are not read, an empty table (or one without a usable vector) gives no codes. Components
    whose integers pass 31 bits are an OverflowError, never a wrong distance.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part")
    kept = kept_vectors(table.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(label).alias("l")), "v")
    kind = {n: table.schema[c].dataType.simpleString() for n, c in (("k", key), ("l", label))}
    even = kept.where((F.size("v") % parts == 0) & F.col("k").isNotNull())
    head = even.agg(F.min(F.struct("k", "v")).alias("least")).select("least.v").first()
    length = len(head["v"]) if head["v"] is not None else -1
    coded = kept.where(F.size("v") == length)
    ids = coded.where("k is not null").select("k").mapInArrow(_smallest(entries), f"k {kind['k']}").distinct().orderBy("k").limit(entries)
    seeds = coded.join(F.broadcast(ids), "k").groupBy("k").agg(F.min("v").alias("v")).collect() if length >= 0 else []
    names = [F.col("k").alias(key), F.col("l").alias(label), "code", "error"]
    others = kept.where(F.size("v") != length).select("k", "l", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if seeds:
        first = np.array([r["v"] for r in sorted(seeds, key=lambda r: r["k"])], np.float64).reshape(len(seeds), length)
        books = train_codebooks(coded, np.floor(SCALE * first).astype(np.int64), parts, rounds)
        done = coded.mapInArrow(_coder(books), f"k {kind['k']}, l {kind['l']}, code string, error bigint").unionByName(others)
    else:
        books, done = [], others
    done = Written(done, "codes").df
    totals = done.groupBy("l").agg(F.sum("error").alias("label_error"))
    joined = done.alias("d").join(sent(totals).alias("t"), F.col("d.l").eqNullSafe(F.col("t.l")))
    return joined.select("d.k", "d.l", "code", "error", "label_error").select(*names, "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _smallest(most: int):
    """A function that hands over a task's ``most`` smallest distinct values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = set(), None
        for batch in batches:
            schema = batch.schema
            held = set(sorted(held.union(batch.column(0).to_pylist()))[:most])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(held), schema.field(0).type)], schema=schema)

    return run


def _coder(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                found = list(_assign(own, batch))
                index = np.stack([i for _, i, _ in found], 1).astype(np.uint8)
                code = pa.array([x.tobytes().hex() for x in index], pa.string())
                error = pa.array(sum(e for _, _, e in found), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), code, error], names=["k", "l", "code", "error"])

    return run
