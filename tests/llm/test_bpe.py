import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from scholar_spark.llm.bpe import Codec
from scholar_spark.llm.tokenize import add_token_counts, count_tokens, encode_digests, encode_documents, fit_bytes, prefix_table
from tokenizers import Tokenizer

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "It's we'll  they'VE\n\n x  y\t\tz  ", "<|endoftext|>hi<|startoftext|> <|endoftext|>", "ΣΑΣ İstanbul ẞ ﬁ Å é",
    "日本語テキスト 🙂🙂🙂", "a" * 3000, "\x1c\x1d x\x85y\xa0z　w ", "١٢٣ 4½ x²", "a\n b", "a\n", "\nb c\n\nd", " a b", "a b ",
]


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdefgh istnr'e.,!19\né$🙂 \t") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    return ODD + made + ["".join(rng.choice("ab ' \n.") for _ in range(rng.randint(1, 30))) for _ in range(500)]


def frame(spark, rows, schema="doc_id bigint, text string, n_tokens string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_codec_equals_the_library(path):
    library, own = Tokenizer.from_file(path), Codec(path)
    for text in texts():
        want = library.encode(text or "", add_special_tokens=False).ids
        got = own.encode(text or "")
        assert np.frombuffer(got, "<u4").tolist() == want
        assert own.count(text or "") == len(want)
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_queries_equal_the_library(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts()[:60])] + [(None, "null key", None), (1, "", None), (1, "", None)]
    docs = frame(spark, rows)
    library = Tokenizer.from_file(WORD)

    def digests(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    key = lambda r: (r[0] is None, *map(str, r))
    got = sorted((tuple(r) for r in encode_digests(docs, WORD).collect()), key=key)
    assert got == sorted(((i, *digests(t)) for i, t, _ in rows), key=key)
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted((tuple(r)[:4] for r in count_tokens(docs, BYTE).collect()), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    docs = frame(spark, [])
    assert encode_documents(docs, WORD).count() == 0
    assert count_tokens(docs, BYTE).count() == 0


def test_prefix_counts_answer_budgets(spark):
    library, text = Tokenizer.from_file(BYTE), "Unbelievable retitioning of tokens, isn't it?"
    table = prefix_table(text, BYTE)
    own = Codec(BYTE)
    for word in own.words(text):
        counts = own.automaton.prefix_counts(own.spell(word))
        for i, n in enumerate(counts):
            assert n == len(library.encode(word[:i], add_special_tokens=False).ids)
    assert table[-1] == (len(text), len(library.encode(text).ids))
    for budget in range(8):
        assert fit_bytes(own, text, budget) == max(b for b, n in table if n <= budget)
    docs = spark.createDataFrame([(1, text, "kept"), (2, None, "x")], "doc_id bigint, text string, fit_3 string")
    first, empty = add_token_counts(docs, BYTE, (3,)).collect()
    assert first["n_tokens"] == table[-1][1] and first["fit_3"] == "kept" and first["_fit_3"] == fit_bytes(own, text, 3)
    assert empty["n_tokens"] == 0 and empty["_fit_3"] == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_long_words_take_linear_memory(path):
    """Unbroken words of 100,000 to a million symbols, in a few hundred MB."""
    rng = random.Random(1)
    made = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(60_000)), "".join(rng.choice("acgt") for _ in range(1_000_000)), "=" * 1_000_000]
    library, own = Tokenizer.from_file(path), Codec(path)
    tracemalloc.start()
    for text in made:
        got = np.frombuffer(own.encode(text), "<u4")
        assert own.count(text) == len(got)
        part = text if "<" not in own.end else text[:20_000]
        assert np.frombuffer(own.encode(part), "<u4").tolist() == library.encode(part, add_special_tokens=False).ids
    assert tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()


def test_a_full_table_is_emptied(monkeypatch):
    from scholar_spark.llm import bpe

    monkeypatch.setattr(bpe, "MAX_STATES", 40)
    for path in (WORD, BYTE):
        library, own = Tokenizer.from_file(path), Codec(path)
        for text in texts():
            assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_tables_and_batches_stay_small(spark):
    tracemalloc.start()
    own = Codec(WORD, 1 / 3)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 36_000_000
    own.encode(" ".join(f"word{i}" for i in range(60_000)))
    assert len(own.chunk_ids) <= 50_000
    assert "hello" not in own.word_ids and own.encode("hello") == own.chunk_ids["hello"] and "hello" not in own.word_ids
    docs = spark.createDataFrame([(i, "x" * 1_000_000) for i in range(24)], "doc_id int, text string").coalesce(1)
    encode_documents(docs, WORD)  # sets the limit
    sizes = docs.mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1).set_column(0, "doc_id", pa.array([b.nbytes], pa.int64())) for b in batches), "doc_id bigint")
    assert max(r[0] for r in sizes.collect()) < 6_000_000
