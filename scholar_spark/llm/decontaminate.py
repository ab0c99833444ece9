"""Operator 2: benchmark decontamination by template windows with slot consistency.

Texts become templates: numbers, names and units give way to typed placeholders, words are lower-cased
and bared of punctuation. Windows of template tokens are joined by hash against the benchmark's windows.
Windows of one item that lie on one diagonal of a text are merged, and the values that fill the same
slots are compared: a re-parameterised question must change the same value to the same value everywhere,
and different values of one kind to different values. Slots that break this reject the diagonal
(``strict``), or leave the cover, and what is left must still be long enough; the query and the pipeline
do the latter, so that one changed value in a near-verbatim copy does not hide it.

Placeholders alone are no evidence, or an item of one number would be found in every document with a number.
A window with fewer than ``PLAIN`` plain words joins by the values of its slots instead (and not at all, if the
item is shorter than a window); a hit has ``PLAIN`` plain words, or as many tokens that stand there unchanged as
a window has.

The benchmark is sent to the executors in blocks of bounded size; each block is held against all texts
in one pass without a shuffle of the texts.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, arrow_map, free_name, sent

WINDOW = 8
#: A hit covers this share of the item's template tokens, or this many tokens in a row.
SHARE, RUN = 0.5, 13
#: Words that are no slots which a window or a hit must hold, unless it is verbatim.
PLAIN = 3
#: Most characters of benchmark text in a block, and most items.
BLOCK_CHARS, BLOCK_ITEMS = 8_000_000, 20_000
MAX_CHUNKS, SMALL = 300_000, 30_000

#: Unit words; they count as units only right after a number.
UNITS = set(
    """mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs pound pounds oz ounce ounces ton tons
    ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks
    month months year years k c f degree degrees percent usd eur gbp dollar dollars euro euros cent cents hz khz mhz ghz v w kw j kj
    kcal cal pa kpa mph kmh kph people times""".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*(?:%|[a-z]{1,3})?")
MARKS = "\"'()[]{}<>*,;.!?:“”‘’«»"
BARE = re.compile(r"[\W_]+")
#: What ends a sentence, and what may stand after it; what a number may begin with besides a digit.
ENDS, AFTER, SIGNS = set(".!?:"), "\"')]", set("+-$€£")
#: Flags of a chunk: its kind, the lowest two bits, and whether it looks like a name, ends a sentence, is a unit word.
WORD, NUM, OTHER, KIND = 0, 1, 2, 3
NAMED, ENDED, UNIT = 4, 8, 16


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s)


#: Template tokens for the placeholders.
P_NUM, P_NAME, P_UNIT = np.uint64(_hash("\0number")), np.uint64(_hash("\0name")), np.uint64(_hash("\0unit"))
#: What stands for all words and values that no benchmark item has.
P_NONE = _hash("\0none")


class Chunks(dict):
    """What stands between white space -> row of the tables below; emptied when full, between texts.

    Where the ``words`` and ``values`` of a benchmark are given, what is none of them shares one row with all others of
    its flags: no window that holds it can be one of the benchmark's, unless it fills a slot. Common lower-case words
    of that kind are kept only while the table is small, as it is faster then. Rows of new chunks are lists until
    ``settle`` adds them to the tables, all of a text at once.
    """

    def __init__(self, words: set[str] | None = None, values: set[str] | None = None):
        self.words, self.values = words, values
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.n, size = 0, 1 << 12
        self.hash, self.value, self.flags = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        self.new: list[tuple[int, int, int]] = [(P_NONE, P_NONE, WORD)]
        self.shared = {WORD: 0}

    def settle(self) -> None:
        """Add the rows of new chunks to the tables."""
        if not self.new:
            return
        last = self.n
        self.n += len(self.new)
        while self.n > len(self.hash):
            for name in ("hash", "value", "flags"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.hash[last : self.n], self.value[last : self.n], self.flags[last : self.n] = zip(*self.new)
        self.new = []

    def __missing__(self, chunk: str) -> int:
        """The row of a new chunk."""
        words = self.words
        if words is not None and chunk.islower() and chunk.isalpha() and chunk.isascii() and chunk not in words:
            if len(self) < SMALL:
                self[chunk] = 0
            return 0
        plain = chunk.strip(MARKS).lower()
        bare = plain if plain.isalnum() else BARE.sub("", plain)
        flags, known = OTHER, words is None or plain in self.values
        if (plain[:1] in SIGNS or plain[:1].isdecimal()) and NUMBER.fullmatch(plain):
            flags = NUM
        elif bare:
            flags, known = WORD, known or bare in words
            if not chunk.islower():
                letters = chunk if chunk.isalnum() else BARE.sub("", chunk)
                if len(letters) > 1 and letters[0].isupper() and letters[1:].islower():
                    flags |= NAMED
            if bare in UNITS:
                flags |= UNIT
        if not chunk[-1].isalnum() and chunk.rstrip(AFTER)[-1:] in ENDS:
            flags |= ENDED
        i = None if known else self.shared.get(flags)
        if i is None:
            i = self.n + len(self.new)
            own, value = (_hash(bare), _hash(plain)) if known else (P_NONE, P_NONE)
            self.new.append((int(P_NUM) if flags & KIND == NUM else own, value, flags))
            if not known:
                self.shared[flags] = i
        self[chunk] = i
        return i


def template(text: str, chunks: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(template tokens, kind of slot or 0, place of each token among the chunks, chunks, tokens as they stand) of a whole text."""
    if len(chunks) > MAX_CHUNKS:
        chunks.clear_all()
    own, first = [], []
    for line in text.split("\n"):
        first.append(len(own))
        own += line.split()
    if not own:
        return np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, np.int64), own, np.empty(0, np.uint64)
    ids = np.fromiter(map(chunks.__getitem__, own), np.int64, len(own))
    chunks.settle()
    tokens, flags = chunks.hash[ids], chunks.flags[ids]
    kind = flags & KIND
    starts = np.r_[True, flags[:-1] & ENDED > 0]
    starts[np.array(first)[np.array(first) < len(own)]] = True
    slot = np.zeros(len(ids), np.int8)
    slot[kind == NUM] = 1
    slot[(flags & NAMED > 0) & ~starts] = 2
    slot[(flags & UNIT > 0) & np.r_[False, kind[:-1] == NUM]] = 3
    tokens[slot == 2], tokens[slot == 3] = P_NAME, P_UNIT
    at = np.flatnonzero(kind != OTHER)
    return tokens[at], slot[at], at, own, np.where(slot > 0, chunks.value[ids], tokens)[at]


def window_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    if len(tokens) < n:
        return np.empty(0, np.uint64)
    m = len(tokens) - n + 1
    out = tokens[:m].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + tokens[k : k + m]
    return out ^ (out >> np.uint64(32))


def seed_hashes(tokens: np.ndarray, slot: np.ndarray, verbatim: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it has enough plain words) of each window: of its template, or else of what stands there."""
    if len(tokens) < n:
        return np.empty(0, np.uint64), np.empty(0, bool)
    words = np.cumsum(np.r_[0, slot == 0])
    plain = words[n:] - words[:-n] >= PLAIN
    if plain.all():
        return window_hashes(tokens, n), plain
    return np.where(plain, window_hashes(tokens, n), ~window_hashes(verbatim, n)), plain


def _value(chunk: str) -> str:
    return chunk.strip(MARKS).lower()


def _run(cover: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.r_[0, cover.astype(np.int8), 0]))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _one_to_one(pairs: list[tuple]) -> set[tuple]:
    """Of pairs of values those of a one-to-one mapping: the most frequent first, unchanged values before others."""
    count: dict[tuple, int] = defaultdict(int)
    for pair in pairs:
        count[pair] += 1
    there, back = {}, {}
    for mine, other in sorted(count, key=lambda p: (-count[p], p[0] != p[1])):
        if mine not in there and other not in back:
            there[mine], back[other] = other, mine
    return set(there.items())


class Index:
    """The windows of a block of benchmark items, by hash; items shorter than a window are one window."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        chunks, self.items, by = Chunks(), [], defaultdict(list)
        self.values: set[str] = set()
        for item, text in items:
            tokens, slot, at, own, verbatim = template(text or "", chunks)
            if not len(tokens):
                continue
            self.values.update(map(_value, own))
            n = min(window, len(tokens))
            hashes, plain = seed_hashes(tokens, slot, verbatim, n)
            for place, h in enumerate(hashes.tolist()):
                if plain[place] or n == window:
                    by[n].append((h, len(self.items), place))
            if plain[0] and chunks.flags[chunks[own[at[0]]]] & NAMED:  # an item quoted inside a sentence begins with what looks like a name
                by[n].append((int(window_hashes(np.r_[P_NAME, tokens[1:n]], n)[0]), len(self.items), 0))
            self.items.append((item, len(tokens), slot, [_value(own[i]) for i in at.tolist()]))
        self.words = {BARE.sub("", value) for value in self.values} | UNITS
        self.by = {}
        for n, rows in by.items():
            rows.sort()
            h, i, p = (np.array(x, kind) for x, kind in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
            seen = np.zeros(1 << 16, bool)
            seen[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.by[n] = (h, i, p, seen)

    def hits(self, text: str, chunks: Chunks, share: float, run: int, strict: bool = True):
        """(item, tokens covered, tokens of the item, slots, changed slots, longest run) for each diagonal that holds the item."""
        tokens, slot, at, own, verbatim = template(text, chunks)
        found = defaultdict(lambda: defaultdict(list))
        for n, (known, item, place, seen) in self.by.items():
            h, _ = seed_hashes(tokens, slot, verbatim, n)
            maybe = np.flatnonzero(seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
            lo, hi = np.searchsorted(known, h[maybe], "left"), np.searchsorted(known, h[maybe], "right")
            for j in np.flatnonzero(hi > lo).tolist():
                for r in range(lo[j], hi[j]):
                    found[item[r]][maybe[j] - place[r]].append((place[r], n))
        for i, diagonals in found.items():
            name, size, slots, values = self.items[i]
            for shift, windows in diagonals.items():
                cover = np.zeros(size, bool)
                for p, n in windows:
                    cover[p : p + n] = True
                if cover.sum() < share * size and _run(cover) < run:
                    continue
                pairs = {k: ((slots[k], values[k]), (slots[k], _value(own[at[k + shift]]))) for k in np.flatnonzero(cover & (slots > 0)).tolist()}
                good = _one_to_one(list(pairs.values()))
                wrong = [k for k, pair in pairs.items() if pair not in good]
                if wrong and strict:
                    continue
                cover[wrong] = False
                longest = _run(cover)
                if cover.sum() < share * size and longest < run:
                    continue
                changed = sum(mine != other for k, (mine, other) in pairs.items() if cover[k])
                if (cover & (slots == 0)).sum() < PLAIN and cover.sum() - changed < self.window:
                    continue
                yield name, int(cover.sum()), size, len(pairs) - len(wrong), changed, longest


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN, key: str = "doc_id", strict: bool = True
) -> DataFrame:
    """One row for each document and benchmark item whose template it holds with consistent slots.

    Slots that are not consistent reject the place (``strict``) or do not count as covered.

    Columns: key, item_id, n_covered and n_item (template tokens), n_slots, n_changed (slots filled with
    another value: a re-parameterised question), longest_run. The best diagonal of a pair counts (most
    tokens, then fewest changed slots). A hit covers at least ``share`` of the item, or ``run`` tokens in
    a row. Null or empty texts and items hit nothing; items repeated under one id count as one id; an
    empty benchmark or table gives an empty result; texts of any length are read whole; other columns are not read. An item of
    fewer than ``PLAIN`` plain words that is shorter than a window (`5`, `Yes.`, `42 km`) hits nothing. Rows that repeat a key give one row for each item.
    """
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    size = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(1, -(-(size[1] or 0) // BLOCK_CHARS), -(-size[0] // BLOCK_ITEMS))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id bigint, n_covered bigint, n_item bigint, n_slots bigint, n_changed bigint, longest_run bigint"
    out = None
    for b in range(blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toLocalIterator()]
        sent = spark.sparkContext.broadcast(sorted(block, key=str))

        def make(sent=sent):
            index = Index(sent.value, window)
            chunks = Chunks(index.words, index.values)
            return lambda row: ((row[key], *hit) for hit in index.hits(row["text"] or "", chunks, share, run, strict))

        found = arrow_map(docs.select(key, "text"), make, schema)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("n_covered", (-F.col("n_changed")).alias("same"), "n_item", "n_slots", "n_changed", "longest_run"))
    out = out.groupBy(key, "item_id").agg(best.alias("best"))
    return out.select(key, "item_id", *[f"best.{c}" for c in ("n_covered", "n_item", "n_slots", "n_changed", "longest_run")])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, strict: bool = True) -> DataFrame:
    """The rows of ``docs`` whose doc_id holds no benchmark item; null keys are judged together.

    All columns pass through, whatever their names. Null and empty texts hold nothing; rows that repeat a
    doc_id go if any of them holds an item; an empty benchmark keeps all rows.
    """
    name = free_name("leaked", docs.columns)
    leaks = Written(find_leaks(docs, benchmark, strict=strict).select(F.col("doc_id").alias(name)).distinct(), "leaked")
    return docs.join(sent(leaks.df), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
