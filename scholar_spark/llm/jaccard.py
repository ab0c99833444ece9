"""Operator 1: n-gram Jaccard join by parity sketches.

Tokens here are a document's distinct word shingles, as 64-bit hashes. A very wide bit sketch in which
each token flips one bit has a Hamming distance of at most the symmetric difference of two sets (two
tokens on one bit can only lower it). Sets of size a <= b with Jaccard >= 0.8 differ in at most a/4
tokens. The sketch is cut into K > a/4 blocks, so at least one block is equal in both: a document sends
out, for each block, the XOR of its tokens' hashes (a linear digest of the block's parity bits), and
equal digests meet in a shuffle. K depends on the size band: it doubles with the size, and a set whose
smallest possible partner falls into the next lower band also sends that band's blocks. Small sets have
too little in a block to tell them apart, so two blocks at once make their keys (K > a/4 + 1).

Meeting sets form groups, never all pairs: each member is verified against the group's smallest member
and what is linked is joined into components. Groups that still hold several components get further
rounds of stars around other members; after those, only pairs of different components are compared, and
of these only those come out whose narrow parity sketches (1,024 bits in longs) are near enough. A wider
sketch (about one bit a token) then rejects most unequal pairs before any text moves; the rest are
verified on the shingles of the whole texts.

With random hashing a pair is missed only if its differing tokens hit every non-empty block of the
smaller set. There are more than a/4 blocks, and in the small bands as many more as keep the blocks
that stay untouched from being all empty: under 1e-9 for a pair at the threshold (exact formula in the tests).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, arrow_map, connected_components, free_name, release, sent

WORDS = 5
#: Similarity as numerator and denominator: link when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Sets below this size use keys of two blocks; below TINY every token is a block of its own.
PAIRED, TINY = 60, 16
#: Least size and blocks of the bands between; with fewer blocks the untouched ones may all be empty.
LOW_BANDS = ((28, 20), (TINY, 16))
#: Longest group that is gathered to be told by its content; longer ones are passed on as they stream by.
GROUP = 65_536
#: Longs of the narrow sketch, and rounds after the first: stars, the last one pairs across components.
FOLD, ROUNDS = 16, 2
#: Members verified in one task against one smallest member.
STAR = 256
#: Sets or groups that a task remembers so as not to send them twice; a full memory is emptied.
SEEN = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator."""
    x = x + _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; empty without words.

    A-Z are lower-cased and words are parted by ASCII white space; fewer words make one shingle.
    """
    if not text:
        return np.empty(0, np.uint64)
    own = text.encode("utf-8").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    if not len(h):
        return h
    n = min(words, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = _mix(out) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(out + np.uint64(n)))


def most_apart(size: int) -> int:
    """Largest symmetric difference of a set of ``size`` and a larger set that link."""
    return size * (DEN - NUM) // NUM


def band(size: int) -> int:
    """0: tokens as blocks; else the number of blocks, a power of two from ``PAIRED`` on."""
    if size < TINY:
        return 0
    if size < PAIRED:
        return next(k for least, k in LOW_BANDS if size >= least)
    return 1 << most_apart(max(size, 64)).bit_length()


def block_keys(tokens: np.ndarray) -> np.ndarray:
    """The join keys of a set, distinct."""
    size = len(tokens)
    if size < 4:  # such sets link only with equal ones, which share a fingerprint
        return np.empty(0, np.uint64)
    least = -(-size * NUM // DEN)
    out = []
    for k in {band(max(least, 1)), band(size)}:
        if k == 0:
            parts = tokens
        else:
            block = ((tokens >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            digests = np.bitwise_xor.reduceat(_mix(tokens), first)
            parts = np.zeros(k, np.uint64)
            parts[block[first]] = digests
            parts[block[first]] += block[first].astype(np.uint64) * _MIX
        if k == 0 or (k <= band(PAIRED - 1) and least < PAIRED):
            i, j = np.triu_indices(len(parts), 1)
            keys = _mix(parts[i]) ^ (_mix(parts[j] + np.uint64(1)) * np.uint64(3))
            used = (parts[i] != 0) | (parts[j] != 0)
            where = (i * len(parts) + j).astype(np.uint64) if k else np.zeros(len(i), np.uint64)
            out.append(_mix(keys[used] + where[used] * _MIX + np.uint64(2 * k + 1)))
        if k > band(PAIRED - 1):
            out.append(_mix(parts[parts != 0] + np.uint64(2 * k)))
    return np.unique(np.concatenate(out))


def parity_sketch(tokens: np.ndarray) -> bytes:
    """Parity bits, about one a token: 1,024 to 65,536 bits; sketches of unlike width fold onto one another."""
    width = min(1 << 16, 1 << max(10, (len(tokens) - 1).bit_length()))
    bits = np.bincount((_mix(tokens) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(sketch: bytes) -> list[int]:
    """A sketch folded to the narrow width, as longs."""
    x = np.frombuffer(sketch, np.uint8).reshape(-1, FOLD * 8)
    return np.bitwise_xor.reduce(x, axis=0).view("<i8").tolist()


def may_link(n: int, a: bytes, m: int, b: bytes) -> bool:
    """False only if sizes or sketches rule the link out."""
    low, high = min(n, m), max(n, m)
    if DEN * low < NUM * high:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    # symmetric difference <= (n + m)(DEN - NUM)/(DEN + NUM)
    return int(np.bitwise_count(x ^ y).sum()) * (DEN + NUM) <= (n + m) * (DEN - NUM)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def fingerprint(tokens: np.ndarray) -> int:
    """One number for a set, the same for equal sets; as a signed 64-bit integer."""
    return int(np.array([xxhash.xxh3_64_intdigest(tokens.tobytes())], np.uint64).view(np.int64)[0])


def sketch_documents(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, n, set (fingerprint; null if empty), sketch, fold and keys for each row, and the columns ``carry``.

    Copies of one set send keys once for each task, as far as SEEN sets are remembered: that is the combine
    before the shuffle.
    """

    def make():
        seen: set[int] = set()

        def each(row):
            tokens = shingle_set(row[text])
            extra = tuple(row[c] for c in carry)
            if not len(tokens):
                yield row[key], 0, None, None, None, None, *extra
                return
            own = fingerprint(tokens)
            if own in seen:
                yield row[key], len(tokens), own, None, None, None, *extra
            else:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(own)
                sketch = parity_sketch(tokens)
                yield row[key], len(tokens), own, sketch, folded(sketch), block_keys(tokens).astype("<u8").tobytes(), *extra

        return each

    schema = [f"`{key}` bigint, n bigint, set bigint, sketch binary, fold array<bigint>, keys binary"]
    schema += [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return arrow_map(docs.select(key, text, *carry), make, ", ".join(schema))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            keys = [np.frombuffer(k, "<i8") for k in part.column(1).to_pylist()]
            sets = np.repeat(part.column(0).to_numpy(), [len(k) for k in keys])
            if len(sets):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(sets)], names=["key", "set"])
    release()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (key, set): (group, set, least, many) for keys that several sets share.

    Groups of the same members are passed on once for each task. Memory holds one batch and at most
    ``GROUP`` members; a longer group streams through.
    """
    seen: set[int] = set()
    held_key, held = None, np.empty(0, np.int64)  # the run that may go on in the next batch
    stream_least = None  # set while a long run streams through

    def out(group, members, least, many):
        n = len(members)
        columns = [np.full(n, group, np.int64), members, np.full(n, least, np.int64), np.full(n, many)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["group", "set", "least", "many"])

    def close(key, members):
        members = np.unique(members)
        if len(members) < 2:
            return None
        own = int(np.array([xxhash.xxh3_64_intdigest(members.tobytes())], np.uint64).view(np.int64)[0])
        if own in seen:
            return None
        if len(seen) >= SEEN:
            seen.clear()
        seen.add(own)
        return out(own, members, members[0], len(members) > 2)

    for batch in batches:
        keys, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[cut[1:], len(keys)]
        # runs of one row, other than the batch's first and last, are done with
        want = np.flatnonzero(ends - cut > 1)
        want = np.unique(np.r_[0, want, len(cut) - 1])
        ready = []
        for i in want:
            key, members = keys[cut[i]], sets[cut[i] : ends[i]]
            if key == held_key:
                if stream_least is not None:
                    ready.append(out(key, np.unique(members), stream_least, True))
                    continue
                held = np.concatenate([held, members])
                if len(held) > GROUP:
                    held = np.unique(held)
                    if len(held) > GROUP:
                        stream_least = held[0]
                        ready.append(out(key, held, stream_least, True))
                        held = np.empty(0, np.int64)
            else:
                if held_key is not None and stream_least is None and (done := close(held_key, held)) is not None:
                    ready.append(done)
                held_key, held, stream_least = key, members.copy(), None
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
    if held_key is not None and stream_least is None and (done := close(held_key, held)) is not None:
        yield done
    seen.clear()
    release()


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, key: str, text: str) -> Written:
    """Of ``pairs`` (a, b: set, least), those whose whole texts link: (a, b)."""
    small = sets.select(F.col("set"), F.col("n"), F.col("sketch"), F.col("holder"))
    left = small.toDF("a", "na", "ska", "ha")
    right = small.toDF("b", "nb", "skb", "hb")
    near = pairs.join(left, "a").join(right, "b")

    def sift(batches):
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("na", "ska", "nb", "skb")}
            keep = [may_link(*x) for x in zip(c["na"], c["ska"], c["nb"], c["skb"])]
            yield batch.select(["a", "b", "ha", "hb"]).filter(pa.array(keep, pa.bool_()))

    close = Written(near.mapInArrow(sift, "a bigint, b bigint, ha bigint, hb bigint"), "near")
    # stars around b, cut so that one task never holds more than STAR members against it
    per = close.df.groupBy("b").agg(F.count("*").alias("ties"))
    part = F.pmod(F.xxhash64("a"), F.ceil(F.col("ties") / STAR))
    members = close.df.join(per, "b").select(F.col("ha").alias(key), "a", "b", part.alias("part"), F.lit(1).alias("member"))
    centres = members.select("b", "part").distinct().join(close.df.select("b", "hb").distinct(), "b").select(
        F.col("hb").alias(key), F.col("b").alias("a"), "b", "part", F.lit(0).alias("member")
    )
    roles = Written(members.unionByName(centres), "roles")
    texts = docs.select(key, text).join(sent(roles.df.select(key).distinct()), key, "left_semi")
    rows = texts.join(roles.df, key).select("a", "b", "part", "member", text)
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", "member")

    def check(batches):
        centre, tokens = None, None
        for batch in batches:
            a, b, part, member = (batch.column(i).to_pylist() for i in range(4))
            good = []
            for i in range(batch.num_rows):
                own = shingle_set(batch.column(4)[i].as_py())
                if not len(own) or fingerprint(own) != a[i]:  # another row of the same key
                    continue
                if not member[i]:
                    centre, tokens = (b[i], part[i]), own
                elif centre == (b[i], part[i]) and links(own, tokens):
                    good.append((a[i], b[i]))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*good)], names=["a", "b"])
        release()

    found = Written(rows.mapInArrow(check, "a bigint, b bigint"), "links")
    close.drop()
    roles.drop()
    return found


def _across(mixed: DataFrame, turn: int | None) -> DataFrame:
    """Pairs (a > b) of one group and different components that sizes and narrow sketches allow to link.

    With a turn, one side is the group's least member in the turn's own order; else any two members.
    """
    side = F.struct("set", "root", "n", "fold")
    if turn is None:
        other = mixed.select("group", side.alias("y"))
    else:
        order = F.xxhash64("set", F.lit(turn)).alias("order")
        other = mixed.groupBy("group").agg(F.min(F.struct(order, "set", "root", "n", "fold")).alias("y"))
    both = mixed.select("group", side.alias("x")).join(other, "group")
    apart = reduce(Column.__add__, [F.bit_count(F.col("x.fold")[i].bitwiseXOR(F.col("y.fold")[i])) for i in range(FOLD)])
    near = (F.col("x.root") != F.col("y.root")) & F.expr(f"{DEN} * least(x.n, y.n) >= {NUM} * greatest(x.n, y.n)")
    near = near & (apart * (DEN + NUM) <= (F.col("x.n") + F.col("y.n")) * (DEN - NUM))
    if turn is None:
        near = near & (F.col("x.set") > F.col("y.set"))
    return both.where(near).select(F.greatest("x.set", "y.set").alias("a"), F.least("x.set", "y.set").alias("b"))


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Components of documents whose word shingle sets have a Jaccard similarity of 0.8 or more.

    Returns one row per input row: key, n_shingles (set size), component_id (smallest key reachable by
    links, itself included). Rows with a null, empty or wordless text have size 0 and link with nothing.
    Repeated rows each give a row, and rows that repeat a key with another text are linked by their own
    texts. A null key is linked only with rows of the very same shingles. Texts of any length are read
    whole. The columns ``carry`` (none of the names above) pass through, others are not read; an empty
    table gives an empty result.
    """
    base = docs.select(F.col(key).cast("bigint").alias(key), text, *carry)
    drawn = Written(sketch_documents(base, key, text, carry), "sketches")
    filled = drawn.df.where("set IS NOT NULL")
    sets = filled.groupBy("set").agg(
        F.min(key).alias("holder"), F.first("n").alias("n"), F.max("sketch").alias("sketch"), F.max("fold").alias("fold")
    )
    rows = filled.where("keys IS NOT NULL").select("set", "keys").mapInArrow(_key_rows, "key bigint, set bigint")
    groups = Written(
        rows.repartition("key").sortWithinPartitions("key", "set").mapInArrow(
            _groups, "group bigint, set bigint, least bigint, many boolean"
        ),
        "groups",
    )
    stars = groups.df.where("set <> least").select(F.col("set").alias("a"), F.col("least").alias("b")).distinct()
    sets = Written(sets.join(groups.df.select("set").distinct(), "set", "left_semi"), "sets")
    stars = Written(stars, "stars")
    tried, found = [stars], [_verified(base, sets.df, stars.df, key, text)]
    roots = connected_components(found[0].df)

    # groups of three or more that are not yet one component
    held = groups.df.where("many").select("group", "set").distinct()
    held, last = held.join(sets.df.select("set", "n", "fold"), "set"), groups
    for turn in range(1, ROUNDS + 1):
        mixed = held.join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
        mixed = mixed.withColumn("root", F.coalesce("root", "set"))
        several = mixed.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        mixed = Written(mixed.join(several.select("group"), "group", "left_semi"), "mixed")
        last.drop()
        held, last = mixed.df.drop("root"), mixed
        if mixed.df.isEmpty():
            break
        pairs = _across(mixed.df, turn if turn < ROUNDS else None).distinct()
        fresh = Written(pairs.join(reduce(DataFrame.unionByName, [t.df for t in tried]), ["a", "b"], "left_anti"), "across")
        tried.append(fresh)
        if fresh.df.isEmpty():
            continue
        found.append(_verified(base, sets.df, fresh.df, key, text))
        roots = connected_components(reduce(DataFrame.unionByName, [f.df for f in found]))
    for done in (sets, last, *tried, *found):
        done.drop()

    named = filled.select(key, "n", "set", *carry).join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    named = named.select(key, "n", F.coalesce("root", "set").alias("root"), *carry)
    least = named.groupBy("root").agg(F.min(key).alias("component_id"))
    linked = named.join(least, "root").select(key, F.col("n").alias("n_shingles"), "component_id", *carry)
    empty = drawn.df.where("set IS NULL").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"), *carry)
    return linked.unionByName(empty)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id, then of a hash of the row.

    Rows are told apart by doc_id and text; of rows that repeat both one stays. Null doc_ids come first.
    Rows without words link with nothing, but repeated ones are kept once as well. All columns pass
    through, whatever their names; an empty table gives an empty result.
    """
    names = docs.columns
    row = free_name("row", names)
    own = F.xxhash64("doc_id", "text")
    links = link_documents(docs.select(own.alias("row"), "doc_id", "text"), "row", "text", ("doc_id",))
    links = Written(links.select("row", "n_shingles", "component_id", "doc_id"), "linked")
    place = F.struct("doc_id", "row")
    groups = links.df.where("n_shingles > 0").groupBy("component_id").agg(F.min(place).alias("least"), F.max(place).alias("most"))
    groups = Written(groups.where("least <> most").select("component_id", F.col("least.row").alias("least")), "groups")
    gone = Written(links.df.join(sent(groups.df), "component_id").where("row <> least").select("row").distinct(), "gone")
    again = Written(links.df.groupBy("row").agg(F.count("*").alias("many")).where("many > 1").select("row"), "again")
    left = docs.withColumn(row, own).join(sent(gone.df.toDF(row)), row, "left_anti")
    if not again.df.isEmpty():
        again = sent(again.df.toDF(row))
        left = left.join(again, row, "left_anti").unionByName(left.join(again, row, "left_semi").dropDuplicates([row]))
    for done in (links, groups):
        done.drop()
    return left.select(*[f"`{n}`" for n in names])
