"""Operator 13: alignment of two tokenizations of a text over elementary intervals.

The ends of A's and of B's tokens, united and sorted, cut a text into elementary intervals; searching both
arrays of ends for an interval's end gives the A token and the B token that own it: one overlap. Ends that
both share close a group, and the A tokens of a group link with all of its B tokens: the product of a group
is expanded over arrays, of large groups over their distinct ids with how often each stands there.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import SENT_ROWS, Written, arrow_map

#: Links of a group up to which they are written out one by one.
SMALL_GROUP = 1024
#: The split of byte-level vocabularies, fixed by their format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>").fullmatch


class ByteBPE:
    """A byte-level ``tokenizers`` file, special strings taken as text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        at = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(at[c] for c in t): i for t, i in vocab.items() if t not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" ", 1))] for m in merges]
        if made != sorted(made) or spec["model"].get("end_of_word_suffix") or spec["normalizer"]:
            raise ValueError("not a plain byte-level vocabulary whose ids follow the order of its merges")
        self.own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t

    def encode(self, text: str) -> list[int]:
        return self.own.encode_ordinary(" " + text)


class PieceBPE:
    """A ``sentencepiece`` file that puts a blank before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.bytes = [bytes([int(b.group(1), 16)]) if (b := _BYTE(p)) else p.replace("▁", " ").encode() for p in pieces]

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(A owner, B owner, group) of every elementary interval of two ascending arrays of ends with a common last."""
    ends = np.union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = (ends_a[owner_a] == ends) & (ends_b[owner_b] == ends)
    return owner_a, owner_b, np.cumsum(shared) - shared


class Alignment:
    """The groups of one text: each has the A tokens from a start to the next, and so for B."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.ids_a, self.ids_b = ids_a, ids_b
        owner_a, owner_b, group = groups(np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b]))
        self.overlaps, first = len(group), np.flatnonzero(np.diff(group, prepend=-1))
        self.start_a, self.start_b = np.append(owner_a[first], len(ids_a)), np.append(owner_b[first], len(ids_b))
        self.many_a, self.many_b = np.diff(self.start_a), np.diff(self.start_b)
        self.links = self.many_a * self.many_b

    def written(self, labels: list[str]) -> str:
        """``a1,a2|b1;a3|b2,b3``; ``labels`` are the ids with a comma, then with a bar, then with a semicolon."""
        n, out = len(labels) // 3, np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        place_a = np.arange(len(self.ids_a)) + np.repeat(self.start_b[:-1], self.many_a)
        place_b = np.arange(len(self.ids_b)) + np.repeat(self.start_a[1:], self.many_b)
        out[place_a], out[place_b] = self.ids_a, self.ids_b
        out[place_a[self.start_a[1:] - 1]] += n
        out[place_b[self.start_b[1:] - 1]] += 2 * n
        return "".join(map(labels.__getitem__, out.tolist()))[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(A id << 32 | B id, links) of the distinct linked pairs, in order."""
        small = np.flatnonzero(self.links <= SMALL_GROUP)
        many = self.links[small]
        g = np.repeat(small, many)
        k = np.arange(len(g)) - np.repeat(np.cumsum(many) - many, many)
        keys = self.ids_a[self.start_a[g] + k // self.many_b[g]] << 32 | self.ids_b[self.start_b[g] + k % self.many_b[g]]
        keys, times = np.unique(keys, return_counts=True)
        parts = [(keys, times)]
        for g in np.flatnonzero(self.links > SMALL_GROUP).tolist():
            a, times_a = np.unique(self.ids_a[self.start_a[g] : self.start_a[g + 1]], return_counts=True)
            b, times_b = np.unique(self.ids_b[self.start_b[g] : self.start_b[g + 1]], return_counts=True)
            parts.append(((a[:, None] << 32 | b).ravel(), np.outer(times_a, times_b).ravel()))
        if len(parts) == 1:
            return keys, times
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.concatenate([t for _, t in parts]))
        return keys, total


class Aligner:
    def __init__(self, a: ByteBPE, b: PieceBPE):
        self.a, self.b = a, b
        self.size_a, self.size_b = (np.array([len(t) for t in x.bytes]) for x in (a, b))
        n = max(len(a.bytes), len(b.bytes))
        self.labels = [f"{i}{c}" for c in ",|;" for i in range(n)]

    def align(self, text: str) -> Alignment | None:
        """The alignment of a text; None where it is empty or the tokens' bytes aren't those of a blank and the text."""
        if not text:
            return None
        a, b, raw = self.a.encode(text), self.b.encode(text), (" " + text).encode("utf-8")
        if b"".join(map(self.a.bytes.__getitem__, a)) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
            return None
        return Alignment(np.array(a, np.int64), np.array(b, np.int64), self.size_a, self.size_b)


def align_tokens(docs: DataFrame, byte_bpe: str, piece_bpe: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Both tokenizations of every whole text, aligned: key, n_a, n_b, n_groups, n_links, n_overlaps, groups, a, b, n.

    groups is written ``a1,a2|b1;a3|b2,b3``; the arrays a, b and n hold the distinct linked pairs of ids and how
    many links each has, in order of a and b. A text that is null, empty, or not given back byte for byte by
    one of the tokenizers (space and text: a U+2581 becomes a blank) has zeros, '' and empty arrays. Repeated rows
    and null keys give a row each, other columns are not read, an empty table gives an empty result.
    """
    return _aligned(docs, byte_bpe, piece_bpe, key, text, "groups")


def _aligned(docs: DataFrame, byte_bpe: str, piece_bpe: str, key: str, text: str, last: str) -> DataFrame:
    """``align_tokens`` with the groups themselves or their SHA-256."""

    def make():
        own = Aligner(ByteBPE(byte_bpe), PieceBPE(piece_bpe))

        def each(row):
            found = own.align(row[text])
            if found is None:
                yield row[key], 0, 0, 0, 0, 0, "", [], [], []
            else:
                written = found.written(own.labels)
                written = written if last == "groups" else hashlib.sha256(written.encode()).hexdigest()
                pairs, links = found.pairs()
                n = len(found.ids_a), len(found.ids_b), len(found.links), int(found.links.sum()), found.overlaps
                yield row[key], *n, written, (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), links

        return each

    kind = docs.schema[key].dataType.simpleString()
    numbers = ", ".join(f"{n} bigint" for n in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps"))
    return arrow_map(docs.select(key, text), make, f"`{key}` {kind}, {numbers}, {last} string, a array<int>, b array<int>, n array<bigint>")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair) and best (whether it is the highest of its a, ties included)."""
    counts = Written(pairs.groupBy("a", "b").agg(F.count("*").alias("count")), "pairs").df
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, rows: int) -> int | None:
    """The least count that at most ``rows`` pairs reach, None if all pairs are so few."""
    sizes = counts.groupBy("count").agg(F.count("*").alias("pairs"))
    if (sizes.agg(F.sum("pairs")).first()[0] or 0) <= rows:
        return None
    # counts that few pairs have are put together by their leading digits, so that the driver gets a short list
    digits = F.pow(10.0, F.greatest(F.length(F.col("count").cast("string")) - 3, F.lit(0))).cast("long")
    steps = sizes.groupBy((F.ceil(F.col("count") / digits) * digits).alias("at")).agg(F.sum("pairs").alias("pairs")).orderBy(F.desc("at")).collect()
    least, left = steps[0]["at"] + 1, rows
    for r in steps:
        left -= r["pairs"]
        if left < 0:
            break
        least = r["at"]
    return least + 1  # a step holds what lies up to its bound: above it, all belongs to the steps taken


def link_statistics(docs: DataFrame, byte_bpe: str, piece_bpe: str, key: str = "doc_id", text: str = "text", most: int = SENT_ROWS) -> DataFrame:
    """What the query of operator 13 returns: the numbers of ``align_tokens``, n_best, count_sum and groups_sha256.

    An id pair's count is the number of rows that hold it linked; n_best are the links whose count is the highest
    of their A id, ties included; count_sum adds up the counts of all links. groups_sha256 is '' for texts
    without tokens. Odd rows are as in ``align_tokens``: repeated rows count as documents of their own.

    Each text is aligned once and written with its pairs. Pairs are counted with partial sums. The ``most`` most
    frequent pairs are sent to the tasks; where there are more, the others, each held by few documents, are
    joined by a shuffle, so no key is hot.
    """
    done = Written(_aligned(docs, byte_bpe, piece_bpe, key, text, "groups_sha256").withColumn("row", F.monotonically_increasing_id()), "aligned").df
    pairs = done.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("row", "p.a", "p.b", "p.n")
    counts = Written(pair_counts(pairs), "pairs").df
    packed = lambda df: df.withColumn("pair", F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))).drop("a", "b")
    least, pairs, counts = frequent(counts, most), packed(pairs), packed(counts)
    sums = [F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best")]
    if least is None:
        found = pairs.join(F.broadcast(counts), "pair").groupBy("row").agg(*sums)
    else:
        common = F.broadcast(counts.where(F.col("count") >= least))
        rare = pairs.join(common, "pair", "left_anti").join(counts.where(F.col("count") < least).hint("merge"), "pair")
        found = pairs.join(common, "pair").select("row", "n", "count", "best").unionByName(rare.select("row", "n", "count", "best")).groupBy("row").agg(*sums)
    columns = [F.col(key), "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_best", "count_sum")), "groups_sha256", "n_overlaps"]
    return done.drop("a", "b", "n").join(found, "row", "left").select(*columns)
