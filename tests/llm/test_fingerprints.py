import hashlib
import random

import numpy as np
import pytest
from scholar_spark.llm import fingerprints as fp
from scholar_spark.llm import queries

SCHEMA = "doc_id bigint, text string, fingerprint string"


def extension(a, i, b, k):
    n = 0
    while i + n < len(a) and k + n < len(b) and a[i + n] == b[k + n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_spans_and_extensions_equal_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(fp, "BLOCK", rng.choice([7, 64, 1 << 18]))
    a = "".join(rng.choice("ab\x00é🙂") for _ in range(300))
    b = a[40:200] + "".join(rng.choice("ab") for _ in range(100)) + a[:90]
    x, y = fp.Prefixes(a), fp.Prefixes(b)
    for _ in range(300):
        i, k = rng.randint(0, len(a)), rng.randint(0, len(b))
        assert x.extension(i, y, k) == extension(a, i, b, k)
        size = rng.randint(0, 40)
        whole = i + size <= len(a) and k + size <= len(b)
        assert x.equal(i, y, k, size) == (whole and a[i : i + size] == b[k : k + size])
    spans = np.concatenate(list(x.spans(8))).tolist()
    of = {}
    for i, h in enumerate(spans):
        assert of.setdefault(a[i : i + 8], h) == h
    assert len(set(of.values())) == len(of) and len(spans) == len(a) - 7
    assert x.extension(0, fp.Prefixes(a), 0) == 300


def test_powers_beyond_one_table():
    p, b = fp.PRIMES[0], fp.BASES[0]
    powers = fp.Powers(b, p)
    assert powers.span(65_530, 65_560).tolist() == [pow(b, i, p) for i in range(65_530, 65_560)]


def test_least_keeps_the_least_distinct_values():
    rng = np.random.default_rng(1)
    blocks = [np.full(5000, 9, np.uint64), rng.integers(0, 10**6, 4000).astype(np.uint64), rng.integers(0, 300, 900).astype(np.uint64)]
    assert fp.least(iter(blocks), 64).tolist() == np.unique(np.concatenate(blocks))[:64].tolist()


def spans(text):
    return {text[i : i + fp.SPAN] for i in range(len(text) - fp.SPAN + 1)} or {text}


def test_likeness_of_fingerprints():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    off = []
    for _ in range(150):
        a = " ".join(word() for _ in range(rng.randint(3, 300)))
        k = len(a) // rng.choice([2, 3, 5, 10])
        for b in (a[:-k] + " ".join(word() for _ in range(k // 7)), a[k:] + " " + a[:k], word() + " " + a + word()):
            got = fp.likeness(str(fp.Fingerprint.of(a)), str(fp.Fingerprint.of(b)))
            assert got == fp.likeness(str(fp.Fingerprint.of(b)), str(fp.Fingerprint.of(a))) and 0 <= got < 1
            exact = len(spans(a) & spans(b)) / len(spans(a) | spans(b))
            head, tail = extension(a, 0, b, 0), extension(a[::-1], 0, b[::-1], 0)
            ends = min(head + tail, len(a), len(b)) / max(len(a), len(b))
            off.append(got - max(exact, ends))
        other = " ".join(word() for _ in range(100))
        assert fp.likeness(str(fp.Fingerprint.of(a)), str(fp.Fingerprint.of(other))) < 0.1
    assert np.abs(off).mean() < 0.05 and np.abs(off).max() < 0.25
    empty = str(fp.Fingerprint.of(""))
    assert fp.likeness(empty, empty) == 1 and fp.likeness(empty, str(fp.Fingerprint.of("a"))) == 0
    assert fp.likeness(str(fp.Fingerprint.of("a")), str(fp.Fingerprint.of("a"))) == 1
    assert fp.likeness(str(fp.Fingerprint.of("a" * 99)), str(fp.Fingerprint.of("a" * 100))) < 1


def brute(rows):
    """Rows in order, each with its next; a null text is empty."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 3
        text = t[: len(t) - n] + after[:n]
        own, new, follower = map(str, map(fp.Fingerprint.of, (t, text, after)))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out.append((k, len(t), sha, own, new, fp.likeness(own, new), fp.likeness(own, follower)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    odd = [None, "", "a", "ab", "🙂é" * 50, "x" * 200_000, "same text here", "same text here", "\x00\x00\x00\x00"]
    rows = [(i * 37 % 400, "".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 400))), "clash") for i in range(400)]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd)]
    rows += [(2000, "equal rows", None)] * 300 + [(None, "null key", None)]
    spark.createDataFrame(rows, SCHEMA).repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_document_fingerprints(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([r[:2] for r in rows])
    prints = {}
    for r in got.collect():
        prints.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert all(len(x) == 1 for x in prints.values())


def test_small_tables(spark):
    assert fp.compare_edits(spark.createDataFrame([], SCHEMA)).collect() == []
    for rows in ([(1, "only one text", None)], [(1, None, None)], [(5, "abcdef", ""), (4, "uvwxyz", "")]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert sorted((tuple(r) for r in fp.compare_edits(df).collect()), key=str) == brute([r[:2] for r in rows])
        assert {r["fingerprint"] for r in fp.fingerprints(df).collect()} == {str(fp.Fingerprint.of(r[1] or "")) for r in rows}
    # rows of one key and different texts: every row has one follower and follows one
    df = spark.createDataFrame([(7, f"{i} and {i * i} of the texts", "") for i in range(50)], SCHEMA).repartition(5)
    assert len({r["edited_sha256"] for r in fp.compare_edits(df).collect()}) == 50
