import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from scholar_spark.llm import align, queries
from tokenizers import Tokenizer

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, n_a string"
ODD = [
    None, "", " ", "  ", "a", " a  b   c ", "a\n b\t  c\n\n", "tail ", "tail  \n", "\x1c \x1d x\x85 y\xa0 z　 w", "<|endoftext|> <s> </s> <unk> <0x41>",
    "has a ▁ mark", "日本語テキスト 🙂🙂 é é", "it's  we'll\n 'tis", "\x00 \x00", "x" * 3000, "1234567890 " * 300, "ab" * 500 + " c",
]


def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("abcdefgh istnr'e.,!19\né$🙂 \t") for _ in range(rng.randint(1, 200))) for _ in range(150)]
    return ODD + made + ["".join(rng.choice("ab ' \n.\xa0") for _ in range(rng.randint(1, 30))) for _ in range(300)]


class Plain:
    """Whole texts by the libraries, groups by walking over bytes."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
        self.a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}

    def raw_b(self, piece):
        if len(piece) == 6 and piece.startswith("<0x"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, self.raw_b(self.b.id_to_piece(i))) for i in self.b.encode(text)]
        raw = (" " + text).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return []
        out, i, k, left, right, p, q = [], 0, 0, [], [], 0, 0
        while i < len(a) or k < len(b):
            if p <= q:
                left.append(a[i][0])
                p, i = p + len(a[i][1]), i + 1
            else:
                right.append(b[k][0])
                q, k = q + len(b[k][1]), k + 1
            if p == q:
                out.append((left, right))
                left, right = [], []
        return out


def brute(rows):
    plain = Plain()
    found = [(k, plain.groups(t)) for k, t in rows]
    links = [Counter((x, y) for left, right in g for x in left for y in right) for _, g in found]
    count = Counter(pair for c in links for pair in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (k, g), c in zip(found, links):
        written = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g)
        n_best = sum(n for p, n in c.items() if count[p] == best[p[0]])
        sha = hashlib.sha256(written.encode()).hexdigest() if g else ""
        out.append((k, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), n_best, sum(n * count[p] for p, n in c.items()), sha))
    return sorted(out, key=str)


def result(df):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_intervals_have_the_tokens_that_cover_them():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 40)
        a, b = (sorted({n, *rng.choices(range(1, n + 1), k=rng.randint(0, n))}) for _ in "ab")
        left, right, group = align.groups(np.array(a), np.array(b))
        ends = sorted({*a, *b})
        assert [a[i] for i in left] == [min(x for x in a if x >= e) for e in ends]
        assert [b[i] for i in right] == [min(x for x in b if x >= e) for e in ends]
        assert group.tolist() == [sum(x < e for x in set(a) & set(b)) for e in ends]


@pytest.mark.parametrize("most", [1_500_000, 40, 0])
def test_statistics_equal_brute_force(spark, most):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null key"), (3, "twice"), (3, "twice")]
    rows += [(9000 + i, "the very same text, many times over 12345") for i in range(200)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    assert result(align.link_statistics(df, BYTE, PIECE, most=most)) == brute(rows)


@pytest.mark.parametrize("small", [1024, 1, 0])
def test_alignments_equal_a_walk_over_bytes(monkeypatch, small):
    monkeypatch.setattr(align, "SMALL_GROUP", small)
    own, plain = align.Aligner(align.ByteBPE(BYTE), align.PieceBPE(PIECE)), Plain()
    for t in texts():
        found, g = own.align(t), plain.groups(t)
        assert (found is None) == (not g)
        if found:
            assert found.written(own.labels) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            links = Counter((x << 32 | y) for left, right in g for x in left for y in right)
            keys, times = found.pairs()
            assert dict(zip(keys.tolist(), times.tolist())) == links and keys.tolist() == sorted(links)


def test_other_vocabularies_are_an_error():
    with pytest.raises(ValueError):
        align.ByteBPE(public_tokenizers.path("word_bpe_49k.json"))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert align.link_statistics(empty, BYTE, PIECE).collect() == [] and align.align_tokens(empty, BYTE, PIECE).collect() == []
    row = align.align_tokens(spark.createDataFrame([(1, "hello hello", "")], SCHEMA), BYTE, PIECE).first()
    assert row["groups"].count(";") + 1 == row["n_groups"] and sum(row["n"]) == row["n_links"] and row["n_overlaps"] >= row["n_groups"]


def test_query_on_the_smallest_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.op13_token_alignment(spark, sf)) == brute(rows)


def test_a_very_long_text(spark):
    text = "word " * 200_000 + "y" * 100_000
    rows = [(1, text)]
    assert result(align.link_statistics(spark.createDataFrame([(1, text, "")], SCHEMA), BYTE, PIECE)) == brute(rows)
