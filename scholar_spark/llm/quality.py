"""Operator 10: text statistics and a learned decision list of quality rules."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct", "n_marks")
#: Most labelled rows that the rules are learned from, and the seed of the grow and prune parts.
SAMPLE, SEED = 20_000, 7
#: Draws of the rows to grow a rule on that may fail in a row before learning ends.
DRAWS = 12


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words inside a 3-word window that occurs twice or more, distinct words)."""
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    m = len(seen)
    if len(ids) < 3:
        return 0, m
    pairs = ids[:-1] * m + ids[1:]
    if m > 2_000_000:  # three ids no longer fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * m + ids[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0, m
    hit = np.isin(windows, twice)
    cover = np.zeros(len(ids), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum()), m


def count_text(text: str | None) -> tuple:
    """The values of ``COUNTS`` for one whole text; all 0 for null."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    seen, dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    repeat, distinct = repeated_words(words)
    upper = sum(raw.count(b) for b in range(65, 91))
    digits = sum(raw.count(b) for b in range(48, 58))
    marks = raw.count(b"!") + raw.count(b"?") + raw.count(b".") + raw.count(b",")
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(raw.count, SYMBOLS)), dup, repeat, n_lines, upper, digits, distinct, marks


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` for each row of ``docs``; one pass, no shuffle."""

    def make():
        return lambda row: ((row["doc_id"], *count_text(row["text"])),)

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: The statistics that rules may test: name -> numerator, denominator.
RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
    "mark_share": ("n_marks", "n_words"),
}


def ratio(name: str) -> Column:
    top, below = RATIOS[name]
    return F.col(top).cast("double") if below is None else F.col(top) / F.greatest(F.col(below), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Reject where every (statistic, '<=' or '>', threshold) holds."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, t in self.tests:
            out = out & ((ratio(name) <= t) if sign == "<=" else (ratio(name) > t))
        return out

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, t in self.tests:
            out &= (x[name] <= t) if sign == "<=" else (x[name] > t)
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {s} {t:.6g}" for n, s, t in self.tests)


def _grow(x: dict, bad: np.ndarray, cuts: dict, most: int = 4) -> Rule:
    """Add the test of the largest FOIL gain until no good row is covered."""
    rule, held = Rule(()), np.ones(len(bad), bool)
    while len(rule.tests) < most and (held & ~bad).any():
        p0, n0 = (held & bad).sum(), (held & ~bad).sum()
        best = (1e-9, None, None)
        for name, values in x.items():
            order = cuts[name]
            for t in order:
                low = held & (values <= t)
                for sign, m in (("<=", low), (">", held & ~low)):
                    p, n = (m & bad).sum(), (m & ~bad).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (name, sign, float(t)), m)
        if best[1] is None:
            break
        rule, held = Rule((*rule.tests, best[1])), best[2]
    return rule


def _centred(rule: Rule, x: dict) -> Rule:
    """Each threshold moved midway between the rows it parts, the other tests holding."""
    tests = list(rule.tests)
    for i, (name, sign, t) in enumerate(tests):
        held = x[name][Rule((*tests[:i], *tests[i + 1 :])).mask(x)] if len(tests) > 1 else x[name]
        low, high = held[held <= t], held[held > t]
        if len(low) and len(high):
            tests[i] = (name, sign, float((low.max() + high.min()) / 2))
    return Rule(tuple(tests))


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, support: int = 5, most: int = 12, draws: int = DRAWS) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows left, prune it on the rest, keep it if
    it is right at least ``precision`` of the time on both, remove what it covers, go on. Where the rule of one
    draw of the thirds isn't kept, others are tried; after ``draws`` poor ones in a row there is nothing to learn."""
    rng = np.random.default_rng(SEED)
    rules: list[Rule] = []
    left, poor = np.ones(len(bad), bool), 0
    while len(rules) < most and poor < draws and (left & bad).sum() >= support:
        part = rng.random(len(bad)) < 2 / 3
        rule = _tried(x, bad, left, part, precision, support)
        if rule is None:
            poor += 1
        else:
            rules.append(rule)
            left, poor = left & ~rule.mask(x), 0
    return rules


def _tried(x: dict, bad: np.ndarray, left: np.ndarray, part: np.ndarray, precision: float, support: int) -> Rule | None:
    """The rule grown on ``part`` of the rows left and pruned on the others, if it is right often enough."""
    grow, prune = left & part, left & ~part
    if not (grow & bad).any():
        return None
    xg = {k: v[grow] for k, v in x.items()}
    cuts = {k: np.unique(np.quantile(v, np.linspace(0.005, 0.995, 100), method="lower")) for k, v in xg.items()}
    rule = _grow(xg, bad[grow], cuts)
    best = (-1.0, rule)
    for k in range(len(rule.tests), 0, -1):
        short = Rule(rule.tests[:k])
        m = short.mask(x) & prune
        p, n = (m & bad).sum(), (m & ~bad).sum()
        if (worth := (p - n) / max(p + n, 1)) >= best[0]:
            best = (worth, short)
    rule = _centred(best[1], {k: v[left] for k, v in x.items()})
    m = rule.mask(x) & left
    right, mp = (m & bad).sum(), m & prune
    if not rule.tests or right < support or right < precision * m.sum() or (mp & bad).sum() < precision * mp.sum():
        return None
    return rule


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn reject rules from at most ``sample`` labelled rows, chosen by a hash of doc_id.

    Labels whose doc_id or quality is null are not used; a doc_id's repeated labels count once (the
    smallest), as do its repeated documents. Without both classes there is nothing to learn: no rules.
    """
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers: small enough to send to every executor
    rows = text_counts(docs.select("doc_id", "text").join(F.broadcast(own.select("doc_id")), "doc_id"))
    rows = rows.dropDuplicates(["doc_id"]).join(F.broadcast(own), "doc_id").select(
        *[ratio(n).alias(n) for n in RATIOS], (F.col("quality") == 0).alias("bad"), "doc_id"
    )
    got = rows.toPandas().sort_values("doc_id")
    if not len(got) or got["bad"].nunique() < 2:
        return []
    return learn({n: got[n].to_numpy(float) for n in RATIOS}, got["bad"].to_numpy(bool))


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the first rule that holds rejects, else the document stays."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, ``COUNTS``, base_failed and kept for each row of ``docs``.

    A null or empty text has no words, so it fails the base test; a text of any length is read whole.
    Repeated rows and null keys give a row each; other columns are not read. With an empty ``labels`` only
    the base test decides; an empty ``docs`` gives an empty result.
    """
    rules = fit_rules(docs, labels)
    return text_counts(docs).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the query of operator 10 returns, from ``judge_quality``; odd rows and tables are as there."""
    return judge_quality(docs, labels).select("doc_id", *COUNTS[:5], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is judged good, with the columns of ``docs``; one pass over the texts.

    Columns may have any names, those of the counts too. Null and empty texts go, as they have no words;
    repeated rows are judged alike; an empty table gives an empty result.
    """
    rules = fit_rules(docs, labels)
    names = docs.columns
    own = docs.toDF(*[f"in_{i}" for i in range(len(names))])
    text = own.columns[names.index("text")]

    def make():
        return lambda row: ((*row.values(), *count_text(row[text])),)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    counted = arrow_map(own, make, f"{kinds}, " + ", ".join(f"`{c}` bigint" for c in COUNTS))
    return counted.where(verdict(rules)).select(*own.columns).toDF(*names)
