"""Counts of n-grams inside Arrow batches: words as numbers, a gram as its longer prefix's number and its last word's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens counted at once (more in a longer document), and counts that a task holds before it hands them on.
CHUNK, HELD = 1 << 20, 1 << 20


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(tokens, the document of each, numbered from 0) for whole documents."""
    for batch in batches:
        lists = batch.column(0)
        tokens, ends = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
        ends, first = ends - ends[0], 0
        while first < len(lists):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
            docs = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
            yield tokens.slice(int(ends[first]), int(ends[last] - ends[first])), docs
            first = last


def _tally(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs and in how many documents; ``docs`` ascend."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    fresh = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    starts = np.flatnonzero(fresh)
    held = np.cumsum(fresh | np.append(True, docs[1:] != docs[:-1])[: len(keys)])
    ends = np.append(starts[1:], len(keys))
    return keys[starts], ends - starts, (held[ends - 1] - held[starts] + 1) if len(keys) else held


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tokens, docs in _chunks(batches):
        coded = tokens.dictionary_encode()
        keys, total, df = _tally(np.asarray(coded.indices, dtype=np.int64), docs)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(keys)), pa.array(total, pa.int64()), pa.array(df, pa.int64())], names=["w1", "total", "df"])


def word_counts(tokens: DataFrame) -> DataFrame:
    """(w1, total, df) of every word of ``tokens`` (w: a document's)."""
    return tokens.select("w").mapInArrow(_words, "w1 string, total bigint, df bigint").groupBy("w1").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


class Frequent:
    """The words and grams of each level so far that are frequent: at most some million numbers."""

    def __init__(self, words: pa.Array):
        self.words, self.levels = words, []

    def add(self, keys: np.ndarray) -> None:
        self.levels.append(np.sort(keys))

    def places(self, tokens: pa.Array, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the frequent gram of the highest level that begins at each token, and of the word; -1 for none."""
        codes = np.asarray(pc.fill_null(pc.index_in(tokens, value_set=self.words), -1), dtype=np.int64)
        at = codes
        for k, known in enumerate(self.levels, 2):
            at, keys, where = np.full(len(at), -1), *self.candidates(at, codes, docs, k)
            if len(known) and len(keys):
                found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                at[where] = np.where(known[found] == keys, found, -1)
        return at, codes

    def candidates(self, at: np.ndarray, codes: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and places of the k-grams of one document whose two shorter ones are frequent."""
        n = max(0, len(at) - k + 1)
        where = np.flatnonzero((at[:n] >= 0) & (at[1 : n + 1] >= 0) & (docs[:n] == docs[k - 1 : n + k - 1]))
        return at[where] * len(self.words) + codes[where + k - 1], where

    def spelt(self, keys: np.ndarray) -> list[pa.Array]:
        """The words of grams of the level above."""
        out = []
        for known in [None, *self.levels][::-1]:
            out.append(self.words.take(pa.array(keys % len(self.words))))
            keys = keys // len(self.words)
            keys = keys if known is None else known[keys]
        return [self.words.take(pa.array(keys)), *out[::-1]]


def _counter(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def handed(parts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], names=["key", "total", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Frequent = shared.value
        k, parts = len(known.levels) + 2, []
        for tokens, docs in _chunks(batches):
            keys, where = known.candidates(*known.places(tokens, docs), docs, k)
            parts.append(_tally(keys, docs[where]))
            if sum(len(p[0]) for p in parts) > 2 * HELD:
                parts = [_summed(parts)]
                if len(parts[0][0]) > HELD:
                    yield handed(parts.pop())
        if parts:
            yield handed(_summed(parts))

    return run


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, total, df = (np.concatenate(p) for p in zip(*parts))
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, *(np.bincount(inverse, x, len(keys)).astype(np.int64) for x in (total, df))  # doubles: exact below 2^53


def _speller(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = shared.value.spelt(np.asarray(b.column(0), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*words, *b.columns], names=[*(f"w{i + 1}" for i in range(len(words))), *b.schema.names])

    return run


def longer_counts(tokens: DataFrame, known: Frequent, least: int) -> DataFrame:
    """(w1 ... wk, key, total, df) of the grams one word longer than those of ``known`` that ``least`` documents hold."""
    shared, k = tokens.sparkSession.sparkContext.broadcast(known), len(known.levels) + 2
    each = tokens.select("w").mapInArrow(_counter(shared), "key bigint, total bigint, df bigint")
    found = each.groupBy("key").agg(F.sum("total").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= least)
    return found.mapInArrow(_speller(shared), ", ".join(f"w{i} string" for i in range(1, k + 1)) + ", key bigint, total bigint, df bigint")
