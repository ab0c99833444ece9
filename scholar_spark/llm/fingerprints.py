"""Operator 11: document fingerprints from prefix polynomial hashes.

A text has the prefix arrays C[i] = sum over k < i of (c_k + 1) B^k, modulo two primes below 2^31. The hash
of any span is (C[j] - C[i]) B^-i, whatever its place: two spans are equal, up to a chance of 2^-61 or so, if
their hashes are, and the longest common extension of two places is found by binary search.

A fingerprint keeps of these arrays what comparing needs: the length and the hash of the whole; hashes of
prefixes and of suffixes whose lengths are the multiples of a power of two (so the steps of any two texts
nest); and the least mixed hashes of all spans of ``SPAN`` code points, a bottom sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_ROWS, Written, arrow_map, release, to_batch

#: Primes and bases, fixed: fingerprints of different runs compare.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_664_525_117)
#: Code points of a span, values of a sketch, steps of a grid.
SPAN, SKETCH, STEPS = 8, 48, 16
#: Positions hashed at once: temporaries stay small for texts of any length.
BLOCK = 1 << 18
_U = np.uint64


class Powers:
    """Powers of a base (or of its inverse) modulo a prime, in two tables of 2^16: any exponent below 2^32."""

    def __init__(self, base: int, prime: int):
        self.prime, n = _U(prime), 1 << 16
        self.low, self.high = self._row(base, n, prime), self._row(pow(base, n, prime), n, prime)

    def _row(self, base: int, n: int, prime: int) -> np.ndarray:
        out, size = np.ones(n, _U), 1
        while size < n:  # doubles what is known
            out[size : 2 * size] = out[:size] * _U(pow(base, size, prime)) % _U(prime)
            size *= 2
        return out

    def span(self, i: int, j: int) -> np.ndarray:
        """The powers from i to j - 1."""
        if j <= len(self.low):
            return self.low[i:j]
        return self.at(np.arange(i, j))

    def at(self, i: np.ndarray) -> np.ndarray:
        return self.low[i & 0xFFFF] * self.high[i >> 16] % self.prime


@lru_cache(maxsize=1)
def tables() -> list[tuple[np.uint64, Powers, Powers]]:
    return [(_U(p), Powers(b, p), Powers(pow(b, -1, p), p)) for p, b in zip(PRIMES, BASES)]


class Prefixes:
    """The prefix arrays of a text."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.n, self.sums = len(code), []
        for prime, powers, _ in tables():
            sums = np.zeros(self.n + 1, _U)
            for i in range(0, self.n, BLOCK):
                j = min(i + BLOCK, self.n)
                term = (code[i:j].astype(_U) + _U(1)) * powers.span(i, j) % prime
                sums[i + 1 : j + 1] = (np.cumsum(term) + sums[i]) % prime
            self.sums.append(sums)

    def hashes(self, i, j) -> np.ndarray:
        """Hashes of the spans from i to j - 1 (arrays, or slices of one step)."""
        out = []
        for (prime, _, inverse), sums in zip(tables(), self.sums):
            back = inverse.span(i.start, i.stop) if isinstance(i, slice) else inverse.at(i)
            out.append((sums[j] + prime - sums[i]) % prime * back % prime)
        return out[0] << _U(31) | out[1]

    def hash(self, i: int, j: int) -> int:
        return int(self.hashes(np.array([i]), np.array([j]))[0])

    def equal(self, i: int, other: Prefixes, k: int, size: int) -> bool:
        """Whether the spans of ``size`` code points from i here and from k in ``other`` are equal."""
        return i + size <= self.n and k + size <= other.n and self.hash(i, i + size) == other.hash(k, k + size)

    def extension(self, i: int, other: Prefixes, k: int) -> int:
        """How many code points from i here and from k in ``other`` are the same."""
        return most_equal(min(self.n - i, other.n - k), lambda size: self.hash(i, i + size) == other.hash(k, k + size))

    def spans(self, width: int) -> Iterator[np.ndarray]:
        """Hashes of all spans of ``width`` code points, in blocks; of the whole text where it is shorter."""
        if self.n < width:
            yield self.hashes(np.array([0]), np.array([self.n]))
        else:
            for i in range(0, self.n - width + 1, BLOCK):
                j = min(i + BLOCK, self.n - width + 1)
                yield self.hashes(slice(i, j), slice(i + width, j + width))


def most_equal(most: int, same) -> int:
    """The largest number up to ``most`` for which ``same`` holds, as it does for all smaller ones (and for 0)."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if same(mid) else (low, mid - 1)
    return low


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes scattered over 64 bits, one to one."""
    h = (h ^ h >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> _U(27)) * _U(0x94D049BB133111EB)
    return h ^ h >> _U(31)


def least(blocks: Iterator[np.ndarray], k: int) -> np.ndarray:
    """The k least distinct values."""
    held = np.empty(0, _U)
    for block in blocks:
        if len(held) == k:
            block = block[block < held[-1]]
        if len(block) > 8 * k:  # most of a block can't be among the least, unless it repeats itself
            some = np.unique(np.partition(block, 4 * k)[: 4 * k])
            block = some if len(some) >= k else np.unique(block)
        held = np.unique(np.concatenate([held, block]))[:k]
    return held


class Fingerprint:
    """What is kept of a text; its bytes are the length, the hash of the whole, prefixes, suffixes, sketch."""

    __slots__ = ("n", "whole", "heads", "tails", "sketch")

    def __init__(self, n: int, whole: int, heads: np.ndarray, tails: np.ndarray, sketch: np.ndarray):
        self.n, self.whole, self.heads, self.tails, self.sketch = n, whole, heads, tails, sketch

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        own = Prefixes(text)
        ends = np.arange(1, own.n // step(own.n) + 1) * step(own.n)
        heads, tails = own.hashes(np.zeros_like(ends), ends), own.hashes(own.n - ends, np.full_like(ends, own.n))
        sketch = least(((mixed(h) >> _U(32)) for h in own.spans(SPAN)), SKETCH) if own.n else np.empty(0, _U)
        return cls(own.n, own.hash(0, own.n), *((mixed(h) >> _U(32)).astype(">u4") for h in (heads, tails)), sketch.astype(">u4"))

    @classmethod
    def read(cls, written: str) -> Fingerprint:
        raw = bytes.fromhex(written)
        n, whole = (int.from_bytes(raw[i : i + 8], "big") for i in (0, 8))
        values, k = np.frombuffer(raw[16:], ">u4"), n // step(n)
        return cls(n, whole, values[:k], values[k : 2 * k], values[2 * k :])

    def __bytes__(self) -> bytes:
        return b"".join([self.n.to_bytes(8, "big"), self.whole.to_bytes(8, "big"), *(x.tobytes() for x in (self.heads, self.tails, self.sketch))])

    def __str__(self) -> str:
        return bytes(self).hex()

    def common(self, other: Fingerprint) -> int:
        """Code points that both begin with, and then that both end with, found on the grids: a lower bound."""
        size = max(step(self.n), step(other.n))
        total = min(self.n, other.n)
        for here, there in ((self.heads, other.heads), (self.tails, other.tails)):
            a, b = (x[size // step(n) - 1 :: size // step(n)] for x, n in ((here, self.n), (there, other.n)))
            total -= size * most_equal(min(len(a), len(b)), lambda i: a[i - 1] == b[i - 1])  # noqa: B023
        return min(self.n, other.n) - max(total, 0)

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal texts alone; else the larger of two estimates below 1.

        They are the share of the longer text that stands in a common beginning and end, and the Jaccard
        similarity of the spans, estimated from the sketches (standard error 0.075 at most, exact for texts of
        few spans).
        """
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        union = np.union1d(self.sketch, other.sketch)[:SKETCH]
        both = np.isin(union, self.sketch, assume_unique=True) & np.isin(union, other.sketch, assume_unique=True)
        longer = max(self.n, other.n)
        return min(max(self.common(other) / longer, float(both.mean())), 1 - 1 / (longer + 1))


def step(n: int) -> int:
    """The power of two whose multiples up to n number at most STEPS."""
    return 1 << max(0, (n // (STEPS + 1)).bit_length())


def likeness(a: str, b: str) -> float:
    """``Fingerprint.likeness`` of two written fingerprints."""
    return Fingerprint.read(a).likeness(Fingerprint.read(b))


def edited(text: str, after: str) -> str:
    """``text`` whose last third has given way to as many first code points of ``after``, or all of them."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars and the fingerprint of every whole text; a null text is empty.

    Repeated rows and null keys give a row each, other columns are not read, an empty table gives an empty result.
    Memory is linear in the longest text.
    """
    def make():
        def each(row):
            own = Fingerprint.of(row[text] or "")
            yield row[key], own.n, str(own)

        return each

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), make, f"`{key}` {kind}, n_chars bigint, fingerprint string")


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how like they are.

    The next document is that of the next smaller key; after the last comes the first. Null keys come last;
    rows of one key are ordered by a hash of the text, then by the text. Returns key, n_chars (code points),
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. A null text is empty; a single
    row follows itself; equal rows follow one another; other columns are not read; an empty table gives none.

    Texts are dealt into ranges of keys once (rows of one key go apart by hash) and read in order, each task
    holding two of them. What needs the first row of the next range is kept with the results and done last.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = docs.schema[key].dataType.simpleString()
    result = f"k {kind}, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    arrow = to_arrow_schema(_parse_datatype_string(f"{result}, place string, part int, t string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, last, part = [], 0, None, TaskContext.get().partitionId()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = k, t, Fingerprint.of(t)
                if last is None:
                    out.append((k, None, None, None, None, None, None, "first", part, t))
                else:
                    out.append((*compared(*last, t, now[2]), None, part, None))
                held, last = held + 4096 + (len(t) if len(out) == 1 else 0), now
                if held >= BATCH_BYTES or len(out) >= BATCH_ROWS:
                    yield to_batch(out, arrow)
                    out, held = [], 0
        if last is not None:
            out.append((last[0], None, None, None, None, None, None, "last", part, last[1]))
            yield to_batch(out, arrow)
        release()

    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    order = [F.desc_nulls_last("k"), F.xxhash64("t")]
    dealt = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order, "t")
    done = Written(dealt.mapInArrow(run, f"{result}, place string, part int, t string"), "fingerprints").df
    # a row a range: which range comes next, the first after the last
    ranges = done.where("place = 'first'").select("part")
    turn = Window.orderBy("part")
    follows = ranges.select("part", F.coalesce(F.lead("part").over(turn), F.first("part").over(turn)).alias("next"))
    ends = done.where("place = 'last'").select("part", "k", "t").join(follows, "part")
    ends = ends.join(done.where("place = 'first'").select(F.col("part").alias("next"), F.col("t").alias("after")), "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = pa.schema(list(arrow)[:7])
        for batch in batches:
            for k, t, after in zip(*(c.to_pylist() for c in batch.columns)):
                yield to_batch([compared(k, t, Fingerprint.of(t), after, Fingerprint.of(after))], short)

    main = done.where("place is null").select(*[f.name for f in list(arrow)[:7]])
    every = main.unionByName(ends.select("k", "t", "after").mapInArrow(finish, result))
    written = [F.lower(F.hex(n)).alias(n) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return every.select(F.col("k").alias(key), "n_chars", *written, "near_edited", "near_next")


def compared(k, text: str, own: Fingerprint, after: str, follower: Fingerprint) -> tuple:
    changed = edited(text, after)
    print_ = own if changed == text else Fingerprint.of(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest()
    return k, own.n, sha, bytes(own), bytes(print_), own.likeness(print_), own.likeness(follower)
