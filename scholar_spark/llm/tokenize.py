"""Operators 7 and 8: BPE encoding and decoding, and token counts at every prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, codec
from .common import arrow_map, free_name


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", tables: float = 1.0, keep: bool = True) -> DataFrame:
    """Encode and decode every whole text with the vocabulary file ``tokenizer``.

    Returns one row per input row: the key, n_tokens, token_ids (little-endian unsigned 32-bit integers
    as binary) and decoded (the ids' arc labels, special tokens included). A null text is empty: no
    tokens, decoded ''. A text of any length is read whole, in memory linear in its size. Repeated rows and
    null keys give a row each; other columns are not read; an empty table gives an empty result.
    ``tables`` scales the worker's tables and ``keep`` holds them between tasks: time or memory, not exactness.
    """

    def make():
        own = codec(tokenizer, tables) if keep else Codec(tokenizer, tables)

        def each(row):
            ids = own.encode(row[text] or "")
            yield row[key], len(ids) // 4, ids, own.decode(ids)

        return each

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), make, f"`{key}` {kind}, n_tokens bigint, token_ids binary, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """What the query of operator 7 returns, read from ``encode_documents``, row by row: odd rows are as there."""
    return encode_documents(docs, tokenizer).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256")
    )


def fit_bytes(own: Codec, text: str, budget: int) -> int:
    """The most bytes of ``text`` whose words and last word's prefix take at most ``budget`` tokens.

    Each word's prefix counts are its own (stored with the word), so only the word in which the budget
    ends is looked into. Counts inside it may fall again (a longer prefix can merge into fewer tokens):
    its last prefix within the budget counts, not the first that exceeds it.
    """
    if own.end:
        raise ValueError("a vocabulary with word ends has no count inside a word")
    at = n = 0
    for special, part in own.parts(text):
        if special is not None:
            if n == budget:
                return at
            at, n = at + len(str(own.names[special]).encode("utf-8")), n + 1
            continue
        for found in own.split.finditer(part):  # no further than the budget
            word = found.group()
            more = own.word_count[word]
            if n + more > budget:
                counts = own.automaton.prefix_counts(own.spell(word))
                return at + max(i for i, c in enumerate(counts) if n + c <= budget)
            at, n = at + len(word.encode("utf-8")), n + more
    return at


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count of every whole text, from the last of each word's prefix counts.

    Returns one row per input row: the key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and
    fit_bytes (how many bytes of the text fit the limit, from the prefix counts). A null or empty text has 0
    bytes and 0 tokens; a text of any length is read whole, in memory linear in its longest word. Repeated
    rows and null keys give a row each; other columns are not read; an empty table gives an empty result.
    """

    def make():
        own = codec(tokenizer)

        def each(row):
            t = row[text] or ""
            n, size = own.count(t), len(t.encode("utf-8"))
            yield row[key], size, n, n > limit, size if n <= limit else fit_bytes(own, t, limit)

        return each

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), make, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_bytes bigint")


def prefix_table(text: str, tokenizer: str) -> list[tuple[int, int]]:
    """(bytes, tokens) at every byte prefix of ``text`` that ends inside or after one of its words.

    The count at a prefix is that of the words before it plus the word's own prefix count, so a budget
    or truncation question needs no encoding. Word-end vocabularies have no such table; '' has (0, 0) only.
    """
    own = codec(tokenizer)
    if own.end:
        raise ValueError("a vocabulary with word ends has no count inside a word")
    out, at, n = [(0, 0)], 0, 0
    for special, part in own.parts(text):
        if special is not None:
            at, n = at + len(str(own.names[special]).encode("utf-8")), n + 1
            out.append((at, n))
        for w in own.words(part):
            counts = own.automaton.prefix_counts(own.spell(w))
            out += [(at + i, n + c) for i, c in enumerate(counts[1:], 1)]
            at, n = out[-1]
    return out


def add_token_counts(docs: DataFrame, tokenizer: str, limits: tuple[int, ...] = (512,), text: str = "text") -> DataFrame:
    """``docs`` with n_tokens and, for each limit, fit_<limit>: how many UTF-8 bytes of the text fit it.

    All columns of ``docs`` pass through; where one has a name of ours, ours gets a leading underscore.
    Null and empty texts have 0 of all; texts are read whole; every row gives a row.
    """
    names = docs.columns
    added = [free_name(n, names) for n in ("n_tokens", *(f"fit_{k}" for k in limits))]

    def make():
        own = codec(tokenizer)

        def each(row):
            t = row[text] or ""
            yield (*[row[n] for n in names], own.count(t), *[fit_bytes(own, t, k) for k in limits])

        return each

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return arrow_map(docs, make, ", ".join([*kinds, *(f"`{n}` bigint" for n in added)]))
