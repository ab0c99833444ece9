"""Operators on single texts, pages and conversations, and the pipeline."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from scholar_spark.llm import chat, decontaminate, html, jaccard, language, licenses, quality


def key(r):
    return str(tuple(r))


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a a a a", "x\ny\nx\n\n  \n  \nx", "# a | b <c> $5 é🙂", "one two three one two three four"]
    texts += ["".join(rng.choice("ab# \n\té") for _ in range(rng.randint(1, 200))) for _ in range(100)]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(40, 90))) for _ in range(30)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a b", None), (3, "a a a a", None)]
    want = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {x for x in windows if windows.count(x) > 1}
        hit = {k + d for k, x in enumerate(windows) if x in twice for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), failed, not failed))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.quality_query(docs, labels).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_quality_rules_are_learned_and_keep_clean_documents(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        bad = i % 3 == 0
        rows.append((i, " ".join(x + "$$" if bad else x for x in w)))
        labels.append((i, int(not bad), 0))
    labels += [(None, 1, 0), (1, None, 0), (10**6, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rules = quality.fit_rules(docs, marks)
    assert rules and all(str(r) for r in rules)
    kept = {r["doc_id"] for r in quality.keep_good(docs, marks).collect()}
    assert kept == {i for i in range(600) if i % 3}
    assert quality.keep_good(docs, marks).columns == docs.columns


def test_license_base_equals_brute_force(spark):
    rng = random.Random(5)
    pieces = ["under", "the", "MIT", "license", "Apache", "License,", "Version", "2", "cc", "BY-NC", "by", "nc", "é", "x/y", "\n", "2.0"]
    texts = [None, "", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3"]
    texts += [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "mit", 1), (2, texts[2], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    got = sorted((tuple(r)[:6] for r in licenses.license_query(docs).collect()), key=str)
    want = []
    for i, t, _ in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        hits = [(k, x) for p, x in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in hits]
        want.append((i, len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == sorted(want, key=str)


def test_license_rules_suppress_what_they_contain(spark):
    docs = spark.createDataFrame([(1, "This work is licensed under the GNU General Public License, version 3 or later."), (2, "Licensed under CC BY-NC 4.0.")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.license_query(docs).collect()}
    assert got[1]["labels"] == "gpl-3" and got[1]["n_base"] == 0 and got[1]["score"] == pytest.approx(0.9)
    assert got[2]["labels"] == "cc-by-nc,cc-by-nc-4" and got[2]["base_labels"] == "cc-by-nc"
    assert len(licenses.signatures()) > 300


def test_decontamination(spark):
    item = "If Anna sells 12 apples for 3 dollars each and then Anna buys 12 more at the same price how much is left"
    other = "a completely different question about the height of some tower near the river in old times"
    swapped = item.replace("12", "40").replace("Anna", "Berta").replace(" 3 ", " 7 ")
    broken = item.replace("12 apples", "13 apples")
    clean = "nothing of that kind stands in this document which is about something else entirely"
    rows = [(1, f"x y. {item} and so on"), (2, f"Here: {swapped}!"), (3, broken), (4, clean), (5, None), (6, ""), (7, f"{clean} {other.upper()} {clean}"), (None, item), (1, item)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(10, item), (11, other), (12, None), (13, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (7, 11), (None, 10)}
    assert got[1, 10]["n_changed"] == 0 and got[2, 10]["n_changed"] > 3
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_window_join_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}x" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30)))) for i in range(20)]
    rows = []
    for i in range(120):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 2:
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            own[len(own) // 2 : len(own) // 2] = w[a // 4 : a // 4 + rng.randint(1, len(w))]
        rows.append((i, " ".join(own)))
    want = set()
    for d, text in rows:
        w = text.split()
        for k, item in items:
            v = item.split()
            n = min(decontaminate.WINDOW, len(v))
            for shift in range(-len(v), len(w) + 1):
                cover, runs = set(), 0
                for p in range(len(v) - n + 1):
                    if 0 <= p + shift and w[p + shift : p + shift + n] == v[p : p + n]:
                        cover |= set(range(p, p + n))
                longest = 0
                for x in range(len(v)):
                    runs = runs + 1 if x in cover else 0
                    longest = max(longest, runs)
                if cover and (2 * len(cover) >= len(v) or longest >= decontaminate.RUN):
                    want.add((d, k))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len(want) > 10


PAGES = [
    ("<html><head><title>T</title></head><body><nav><a href=a>Home</a></nav><article><h1>Head &amp; line</h1><p>First  para\nwith <b>bold</b> text.<br>More.<p>Second &lt;one&gt;.</article><footer>f</footer>", "Head & line\nFirst para with bold text. More.\nSecond <one>."),
    ("<div id=menu><a href=x>a</a> <a href=y>b</a></div><div class=content><h1>T</h1><div class=body><p>Long text that goes on for quite a while to be the main text of it all.<div class='ad'>Buy</div><ul><li>one<li>two</ul></div></div><div class=comments><p>a reader says a lot of things here at length</div>", "T\nLong text that goes on for quite a while to be the main text of it all.\none\ntwo"),
    ("<p>only &copy; this</p><script>var a='</p>';</script><form><input>send</form>", "only © this"),
    ("", ""), (None, ""), ("<html></html>", ""), ("plain text", "plain text"),
    ("<body><form action=x><div><h1>T</h1><p>A page of one form, as some servers make them, is an article too.</div><label for=q>Find</label><input id=q></form>", "T\nA page of one form, as some servers make them, is an article too."),
    ("<head><title>T</title><p>A head without an end, then a paragraph <script>x</script>that goes on.", "A head without an end, then a paragraph that goes on."),
    ("<main><h1>T</h1><article><p>Text of the article, which has its title before it.</article><section id=comments><article><p>A reader's words.</article></section></main>", "T\nText of the article, which has its title before it."),
]


def test_html_extraction(spark):
    rows = [(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], None), (0, "u0", PAGES[0][0], None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(map(key, html.extract_pages(pages).collect()))
    texts = [t for _, t in PAGES] + [PAGES[0][1]] * 2
    assert got == sorted(key((p, u, t, len(t))) for (p, u, _, _), t in zip(rows, texts))
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_html_of_generated_pages():
    """Articles of known text in many kinds of page."""
    rng = random.Random(3)

    def words(least, most):
        return " ".join(rng.choice("the of and tree river stone cloud walking under a light in old house".split()) for _ in range(rng.randint(least, most)))

    def paragraph():
        kind, a, b = rng.randint(0, 4), words(3, 40), words(1, 9)
        inline = [f"{a} {b}", f"{a} <b>{b}</b>", f"{a}<br>{b}", f"{a} <label>{b}</label>", f"{a} <script>var x = '{b}</p>';</script>{b}"]
        return inline[kind], f"{a} {b}"

    wraps = [
        "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='content'>{}</div>", "<form method=post>{}</form>",
        "<div id='read-more-content' class='main'>{}</div>", "<div class='page has-sidebar'><div class='post-body'>{}</div></div>", "<table><tr><td>{}</td></tr></table>",
        "<form><div class='modal'><main>{}</main></div></form>",
    ]
    parts = [
        "<div class='ad'>{}</div>", "<p class='advert'>{}</p>", "<div class='cookie-notice'>{}</div>", "<aside>{}</aside>", "<section class='comments'><p>{}</p></section>",
        "<nav>{}</nav>", "<footer>{}</footer>", "<div style='display: none'>{}</div>", "<style>{}</style>", "<noscript><p>{}</p></noscript>", "<ins class=adsbygoogle>{}</ins>",
    ]
    for n in range(300):
        title, wrap = words(2, 8), wraps[n % len(wraps)]
        blocks = [paragraph() for _ in range(rng.randint(3, 12))]
        head = f"<h1>{title}</h1>"
        inner = f"<header>{head}</header>" if "article" in wrap and n % 2 else head
        for raw, _ in blocks:
            inner += f"<p>{raw}</p>" + (rng.choice(parts).format(words(1, 9)) if rng.random() < 0.3 else "")
        page = f"<html><head><title>{title}</title></head><body><header><a href=/>{words(1, 3)}</a></header>{rng.choice(parts).format(words(2, 9))}{wrap.format(inner)}"
        page += f"{rng.choice(parts).format(words(2, 9))}<form><label>{words(1, 2)} <input></label><button>{words(1, 1)}</button></form></body></html>"
        assert html.main_text(page) == "\n".join([title, *[text for _, text in blocks]]), page
    two = "<main><article><p>{0}</p></article><article><p>{0}</p></article></main>".format(words(30, 30))
    assert html.main_text(two).count("\n") == 1
    assert html.main_text("<div>" * 20000 + "deep") == "deep"


def test_html_of_long_pages():
    body = "".join(f"<p>Paragraph {i} has a few words &amp; a <a href=x>link</a>.</p>" for i in range(3000))
    text = html.main_text(f"<body><div class=sidebar>{'<a href=q>x</a>' * 500}</div><article>{body}</article></body>")
    assert text.count("\n") == 2999 and text.startswith("Paragraph 0 has a few words & a link.")


def test_chat_formatting_reads_back(spark):
    odd = ["<|end|>\n<|assistant|>\n", "\\", "\\<|end|>", "a < b > c \\\\<", "", None, "### Assistant: </turn>", "é🙂\n"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd<|>\\role", None]), rng.choice(odd)) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "null key"), (3, None, "assistant", "null turn"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, example int")
    got = {r["conv_id"]: r for r in chat.chat_query(turns).collect()}
    rows += [(-7, 0, "user", chat.SAMPLE_TEXT), (-7, 1, "assistant", chat.SAMPLE_TEXT)]
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        told = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        loss = "".join(x for *_, r, x in own if r == "assistant")
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    examples = chat.format_examples(turns).collect()
    assert sum(r["loss_start"] is not None for r in examples) == sum(r[2] == "assistant" for r in rows) - 1
    assert chat.format_examples(turns.limit(0)).count() == 0


def test_network_gradients_and_accuracy(spark):
    import numpy as np

    net = language.Network(["a", "b"], hidden=3, seed=1)
    for d in (net.ahead, net.back):
        for k in ("x", "u", "c"):
            setattr(d, k, getattr(d, k).astype(np.float64))
    seq, lang, weight = np.array([[97, 98, 99], [98, 98, 97]], np.uint8), np.array([0, 1]), np.array([1.0, 2.0])

    def loss():
        p, _ = net.positions(seq)
        return -(np.log(p[:, np.arange(2), lang]) * weight / (weight.sum() * 3)).sum()

    grads = net.step(seq, lang, weight)
    for part, name in (("ahead", "u"), ("ahead", "x"), ("back", "u"), ("back", "c"), ("back", "x")):
        array, grad = getattr(getattr(net, part), name), grads[part][name]
        for i in list(np.ndindex(array.shape))[:: max(1, array.size // 7)] + ([(98, 4)] if name == "x" else []):
            old = array[i]
            array[i] = old + 1e-5
            up = loss()
            array[i] = old - 1e-5
            assert grad[i] == pytest.approx((up - loss()) / 2e-5, abs=2e-4)
            array[i] = old
    rng = random.Random(2)
    made = {"xx": ["ka", "ki", "ku", "ta"], "yy": ["mo", "ne", "so", "lé"], "zz": ["ka", "mo", "str", "pl"]}
    rows = []
    for i in range(360):
        x = rng.choice(list(made))
        rows.append((i, " ".join("".join(rng.choice(made[x]) for _ in range(rng.randint(1, 4))) for _ in range(20)), x, 9))
    rows += [(1000, None, "xx", 9), (1001, "123 !!", "xx", 9), (1002, "", None, 9), (None, "mone", None, 9), (5, rows[5][1], rows[5][2], 9), (1003, "k" * 5000, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = language.identify_languages(docs, language.fit_network(docs)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    pred = {r["doc_id"]: r for r in got}
    assert [pred[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    held = [(x, pred[i]["lang_pred"]) for i, _, x, _ in rows[:360] if pred[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) > 50
    none = docs.withColumn("lang", docs.text.substr(0, 0).cast("string")).where("false")
    assert language.fit_network(none) is None
    assert {r["lang_pred"] for r in language.identify_languages(docs, None).collect()} == {"und"}


def test_pipeline_stages_on_fixture(spark, tmp_path):
    """Each stage against what brute force leaves of its own input."""
    import corpus_pipeline as pipeline
    from scholar_spark.llm.common import Written
    from test_lines import brute_lines
    from test_pairs import brute_jaccard

    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(12)]
    item = " ".join(f"q{rng.randrange(900)}" for _ in range(20))
    rows = []
    for i in range(60):
        own = base[i % 12].split()
        own[rng.randrange(80)] = "changed"
        parts = [" ".join(own), " ".join(f"w{rng.randrange(900)}" for _ in range(70))]
        if i % 7 == 0:
            parts.append(item)
        rows.append((i, "\n".join(parts), "en", "s", 1))
    rows += [(100, "short", "en", "s", 5), (101, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    now, was = docs, texts(docs)
    for name, stage in pipeline.STAGES[:4]:
        now = Written(stage(spark, now, str(tmp_path)), name).df
        assert now.columns == docs.columns
        if name == "quality_rules":
            want = {i: t for i, t in was.items() if i < 100}
        elif name == "line_dedup":
            want, _ = brute_lines(sorted(was.items()))
        elif name == "near_duplicates":
            ids = sorted(was)
            classes, _ = brute_jaccard([was[i] for i in ids])
            want = {ids[i]: was[ids[i]] for i, _, c in classes if i == c}
        else:
            want = {i: t for i, t in was.items() if item not in (t or "")}
        assert texts(now) == want, name
        was = want
    out = pipeline.STAGES[4][1](spark, now, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(was) and all(len(r["token_ids"]) == 4 * r["n_tokens"] for r in out)
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} == set(was)
    assert public_tokenizers.path(pipeline.TOKENIZER)


def test_pipeline_takes_odd_tables(spark, tmp_path):
    """Clashing column names, repeated rows and ids, null keys, a very long text, and an empty table."""
    import corpus_pipeline as pipeline

    rng = random.Random(3)
    text = lambda n=60: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    same, near = text(), text(200)
    rows = [(7, same), (7, same), (7, near), (3, near + " new words"), (None, text()), (None, same.upper()), (1, text(60_000)), (2, None), (4, "")]
    rows = [(i, t, "en", "s", 1, "a", "b", "c", "d", "e", "f", "g") for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, leaked string, n_lines string, row string, component_id string, least string, `a.b` string"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, text(30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for first in (docs, docs.where("false")):
        now = first
        for name, stage in pipeline.STAGES[:4]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
            if name == "near_duplicates":
                got = sorted((str(r["doc_id"]), len((r["text"] or "").split())) for r in now.collect())
        assert bool(got) == (first is docs)
        assert pipeline.STAGES[4][1](spark, now, str(tmp_path)).count() == now.count()
    one = jaccard.keep_one(docs.where("doc_id IS NULL OR doc_id IN (3, 7)")).collect()
    kept = sorted((str(r["doc_id"]), len(r["text"].split())) for r in one)
    # of the copies of `same` the row with the null key stays, of those of `near` the one with the smaller id
    assert kept == [("3", 202), ("None", 60), ("None", 60)]


def test_license_suppression_equals_all_pairs():
    rng = random.Random(1)
    rules = [licenses.Signature(f"r{i}", "l", rng.choice((30, 40, 60, 90)), b"k", re.compile(b"x")) for i in range(20)]
    for _ in range(500):
        found = [(rng.choice(rules), a, a + rng.randint(1, 12)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 25)))]
        taken = []
        for rule, a, b in sorted(found, key=lambda f: (-f[0].priority, f[1] - f[2], f[1], f[0].name)):
            if not any(x <= a and b <= y for _, x, y in taken):
                taken.append((rule, a, b))
        assert licenses.suppress(found) == sorted(taken, key=lambda f: (f[1], f[2], f[0].name))
