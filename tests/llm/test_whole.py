"""Cases that earlier versions of the operators cut."""

import random
from math import comb

from scholar_spark.llm import decontaminate, jaccard, queries


def missed(common, apart, blocks, paired):
    """Chance that the blocks which differing tokens leave untouched are too few or hold no common token."""
    at = [1.0] + [0.0] * apart  # chance that so many blocks are touched
    for _ in range(apart):
        at = [(at[t] * t + (at[t - 1] * (blocks - t + 1) if t else 0)) / blocks for t in range(apart + 1)]
    return sum(p * (1 if blocks - t < 1 + paired else (t / blocks) ** common) for t, p in enumerate(at))


def test_missed_links_stay_below_the_bound():
    for n in range(jaccard.TINY, 260):
        for lost in range(n // 5 + 1):
            for more in range(lost, n // 3 + 1):
                if jaccard.DEN * (n - lost) >= jaccard.NUM * (n + more):
                    assert missed(n - lost, lost + more, jaccard.band(n), n < jaccard.PAIRED) < 1e-9, (n, lost, more)
    assert missed(24, 6, 8, True) > 1e-5 and comb(20, 2) == 190


ITEM = "If Anna sells 12 apples for 3 dollars each and then Anna buys 12 more at the same price how much is left"


def test_one_odd_value_does_not_hide_a_copy(spark, tmp_path):
    short = "We saw Paris and then Paris 5 times"
    odd = [ITEM.replace("12 apples", "13 apples"), ITEM.replace(" 3 ", " 12 "), ITEM.replace("then Anna", "then Ana"), ITEM.replace("then Anna", "then “Anna”")]
    rows = [*enumerate(odd), (7, short.replace("Paris 5", "Rome 5")), (8, "nothing of that kind")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, short)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r for r in queries.op2_decontamination(spark, str(tmp_path)).collect()}
    assert {(i, 1) for i in range(4)} <= set(got) and not any(d == 8 for d, _ in got)
    assert got[0, 1]["n_covered"] == got[0, 1]["n_item"] - 1
    assert got[3, 1]["n_changed"] == 0 and got[3, 1]["n_covered"] == got[3, 1]["n_item"]


def test_inconsistent_slots_do_not_count():
    """All slots odd: too little is left."""
    item = "Anna 3 Anna 3 Anna 3 Anna 3 or"
    index, chunks = decontaminate.Index([(1, "so " + item)], 8), decontaminate.Chunks()
    assert list(index.hits("so " + item, chunks, 0.5, 13, strict=False))
    assert not list(index.hits("so Berta 1 Clara 2 Dora 4 Emma 5 or", chunks, 0.5, 13, strict=False))


def test_short_items_are_no_evidence(spark):
    """Items of one or two tokens hit nothing; runs of numbers hit where they stand verbatim."""
    run = " ".join(str(i * 7919 % 1000) for i in range(60))
    items = [(1, "5"), (2, "Yes."), (3, "42 km"), (4, "Anna 42 km"), (5, run), (6, "What is the tallest tower"), (7, "3 4 5 6")]
    docs = [
        (1, "There are 5 of them and Yes. It was 42 km from here, said Anna 42 km away, 3 4 5 6"), (2, " ".join(str(i) for i in range(32_000))), (3, f"so {run} it is"),
        (4, "he asked what is the tallest tower here"), (5, "5"), (6, "Yes."), (7, "42 km"), (8, "what is the tallest"),
    ]
    leaks = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), strict=False)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} == {(3, 5), (4, 6)}


def consistent(item, text):
    """Most tokens of ``item`` that the same words of ``text`` cover at one place, by trying all one-to-one mappings of values."""
    from itertools import permutations

    best = 0
    v, w = item.split(), text.split()
    slots = [x for x in dict.fromkeys(v) if x.isdigit()]
    for shift in range(len(w) - len(v) + 1):
        own = w[shift : shift + len(v)]
        if any(a.isdigit() != b.isdigit() or not a.isdigit() and a != b for a, b in zip(v, own)):
            continue
        there = list(dict.fromkeys(b for b in own if b.isdigit()))
        there += [None] * max(0, len(slots) - len(there))
        for values in permutations(there, len(slots)):
            of = dict(zip(slots, values))
            best = max(best, sum(a == b if not a.isdigit() else of[a] == b for a, b in zip(v, own)))
    return best


def test_slot_consistency_equals_trying_all_mappings():
    rng, chunks = random.Random(6), decontaminate.Chunks()
    seen = set()
    for _ in range(300):
        item = " ".join(rng.choice(["red", "of", "big", "tree", "1", "2", "3"]) if i else "red of big tree was" for i in range(8))
        swap = {a: rng.choice("123456") for a in "123"}
        text = "x " + " ".join(rng.choice("123456") if a.isdigit() and rng.random() < 0.2 else swap.get(a, a) for a in item.split()) + " y"
        index = decontaminate.Index([(1, item)], 8)
        want, n = consistent(item, text), len(item.split())
        hits = list(index.hits(text, chunks, 0.5, 13, strict=True))
        assert bool(hits) == (want == n)  # all slots agree under one mapping
        loose = list(index.hits(text, chunks, 0.5, 13, strict=False))
        assert loose and max(h[1] for h in loose) <= want
        seen.add(want == n)
    assert seen == {True, False}


def test_words_that_no_item_has_share_rows():
    """Hits are those of a table with a row for every word, names, numbers, units and marks included."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    kinds = [word, lambda: word().title(), lambda: str(rng.randrange(900)), lambda: "km", lambda: word() + ".", lambda: "é" + word(), lambda: "--", lambda: f"({word()}:)"]
    some = lambda n: [rng.choice(kinds[: 1 + rng.randrange(8)])() for _ in range(n)]
    items = [(i, " ".join(some(n))) for i, n in enumerate((3, 6, 8, 12, 20, 40) * 10)]
    index = decontaminate.Index(items, 8)
    every, few = decontaminate.Chunks(), decontaminate.Chunks(index.words, index.values)
    found = 0
    for _ in range(400):
        own = rng.choice(items)[1].split()
        for k in rng.sample(range(len(own)), len(own) // 8):
            own[k] = rng.choice(kinds)()
        text = " ".join(some(60) + own + some(60))
        for strict in (True, False):
            want = sorted(index.hits(text, every, 0.5, 13, strict))
            assert sorted(index.hits(text, few, 0.5, 13, strict)) == want
            found += len(want)
    assert found > 100 and every.n > 5 * few.n
