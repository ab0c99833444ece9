"""Text preparation, n-grams, topic models and topic tables. Articles have id, year, cites, mncs, countries and text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholar_spark import schema as S
from scholar_spark.functions import text as X
from scholar_spark.operators.factors import fit_nmf  # noqa: F401  (the other topic model)
from scholar_spark.operators.grams import Frequent, longer_counts, word_counts
from scholar_spark.operators.graph import Coded
from scholar_spark.operators.lda import Topics, fit_lda  # noqa: F401
from scholar_spark.operators.lineage import SENT_ROWS, Stored, numbered, sent
from scholar_spark.operators.metrics import zero

TEXT_COLUMNS = ("Keywords Plus", "Author Keywords", "Abstract", "Title")

#: Tokens of a sliding window, and what keeps logarithms of absent pairs finite.
WINDOW, EPSILON = 110, 1e-12


def combined_text(columns: tuple[str, ...] = TEXT_COLUMNS) -> Column:
    """The columns joined by blanks; a null one still leaves its blank."""
    return F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns])


def noise_terms(query: str = "", lists: dict[str, str] | None = None) -> list[str]:
    """Stop words, the search query's terms and the noise lists together, sorted."""
    words = set(S.STOPWORDS.split()) | set(S.NOISE_PHRASES) | X.search_terms(query)
    for text in (S.NOISE if lists is None else lists).values():
        words |= set(text.split())
    return sorted(words)


def lemma(w: Column) -> Column:
    """Singular by ending: 'ies' to 'y' beyond five letters, final 's' but not 'ss' off beyond four."""
    n = F.char_length(w)
    return (
        F.when((n > 5) & w.endswith("ies"), F.concat(w.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), n - 1))
        .otherwise(w)
    )


def processed(text: Column, noise: list[str]) -> Column:
    """Lemmas of the words (hyphens inside allowed) that are no noise, nor their lemma, joined by blanks; JVM only."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]+(?:-[a-z]+)*\b"), F.lit(0))
    both = F.transform(words, lambda w: F.struct(w.alias("w"), lemma(w).alias("l")))
    kept = F.filter(both, lambda p: ~p["w"].isin(noise) & ~p["l"].isin(noise))  # a hash set; an array would be searched for each word
    return F.array_join(F.transform(kept, lambda p: p["l"]), " ")


def min_df(documents: int) -> int:
    """A hundredth of the documents, at least 5, within 1 and all of them."""
    return max(1, min(max(5, documents // 100), documents))


def _tokens(docs: DataFrame, text: str) -> DataFrame:
    """(doc, w): the tokens of two or more word characters of each row that has any."""
    found = lambda pattern: F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))
    plain = F.octet_length(text) == F.char_length(text)  # ASCII, for which a plainer pattern does the same
    words = F.when(plain, found(r"\b\w[\w-]*\w\b")).otherwise(found(r"(?U)\b\w[\w-]*\w\b"))
    return docs.select(F.monotonically_increasing_id().alias("doc"), words.alias("w")).where("size(w) > 0")


def _counted(tokens: DataFrame, k: int, below: DataFrame | None = None) -> DataFrame:
    """(w1 ... wk, total, df) of the k-grams; with ``below``, only of those whose two (k-1)-grams it holds.

    Tokens are dealt by document first, so a document's equal grams meet without a second shuffle of grams.
    """
    names = [f"w{i}" for i in range(1, k + 1)]
    shifted = [F.slice("w", i, F.size("w") - (k - 1)).alias(f"w{i}") for i in range(1, k + 1)]
    rows = tokens.where(F.size("w") >= k).repartition("doc").select("doc", F.inline(F.arrays_zip(*shifted)))
    if below is not None:
        for own in (names[:-1], names[1:]):
            rows = rows.join(below.toDF(*own), own, "left_semi")
    each = rows.groupBy("doc", *names).agg(F.count("*").alias("n"))
    return each.groupBy(*names).agg(F.sum("n").alias("total"), F.count("*").alias("df"))


def _shown(found: DataFrame, k: int) -> DataFrame:
    return found.select(F.concat_ws(" ", *[f"w{i}" for i in range(1, k + 1)]).alias("ngram"), F.lit(k).alias("n"), "total", "df")


def ngrams(docs: DataFrame, text: str = "text", n: tuple[int, int] = (1, 4)) -> DataFrame:
    """(ngram, n, total, df): occurrences and documents of every n-gram of tokens of two or more word characters."""
    tokens = _tokens(docs, text)
    return reduce(DataFrame.unionByName, [_shown(_counted(tokens, k), k) for k in range(n[0], n[1] + 1)])


def frequent_ngrams(docs: DataFrame, least: int | None = None, most: float = 0.90, blocked: tuple[str, ...] = S.BLOCKED_PHRASES, text: str = "text", n: tuple[int, int] = (1, 4)) -> DataFrame:
    """``counted_ngrams`` without those that repeat a token, end in the initials of the others, or are blocked."""
    return ngram_filters(counted_ngrams(docs, least, most, text, n), blocked)


def counted_ngrams(docs: DataFrame, least: int | None = None, most: float = 0.90, text: str = "text", n: tuple[int, int] = (1, 4)) -> DataFrame:
    """N-grams in at least ``least`` documents and at most a share ``most`` of them.

    Level by level: a gram is counted only where the two shorter ones inside it are in ``least`` documents,
    so what is shuffled shrinks with each level, and no count of a gram that is returned changes. Grams are numbers,
    counted inside the tasks, as long as a level has at most SENT_ROWS frequent ones: these are sent to all tasks. With
    a share of the documents as ``least`` they do not grow with the documents. Beyond it they are joined as rows.
    """
    documents = docs.count()
    least = min_df(documents) if least is None else least
    tokens, known, levels = Stored(_tokens(docs, text), "tokens").df, None, []
    for k in range(1, n[1] + 1):
        if k == 1:
            found = word_counts(tokens).where(F.col("df") >= least)
        elif known:
            found = longer_counts(tokens, known, least)
        else:
            found = _counted(tokens, k, levels[-1].drop("key", "total", "df")).where(F.col("df") >= least)
        levels.append(Stored(found, f"grams{k}").df)
        if (k == 1 or known) and levels[-1].count() > SENT_ROWS:
            known = None
        elif k == 1:
            known = Frequent(levels[-1].select("w1").toArrow().column(0).combine_chunks())
        elif known:
            known.add(levels[-1].select("key").toArrow().column(0).to_numpy())
    levels = [_shown(found, k) for k, found in enumerate(levels, 1)]
    return reduce(DataFrame.unionByName, levels[n[0] - 1 :]).where(F.col("df") <= most * documents)


def ngram_filters(found: DataFrame, blocked: tuple[str, ...] = S.BLOCKED_PHRASES) -> DataFrame:
    p = F.split("ngram", " ")
    initials = F.array_join(F.transform(F.slice(p, 1, F.size(p) - 1), lambda w: F.substring(w, 1, 1)), "")
    keep = (F.size(F.array_distinct(p)) == F.size(p)) & ((F.size(p) < 2) | (F.element_at(p, -1) != initials)) & ~F.col("ngram").isin(*blocked)
    return found.where(keep)


def k_grid(candidates, documents: int, vocabulary: int) -> list[int]:
    """The candidate topic numbers that the corpus allows, else the largest it does."""
    top = max(2, min(documents - 1, vocabulary - 1))
    return [k for k in candidates if 2 <= k <= top] or [top]


class Vocabulary:
    """The terms of a corpus as a table (term, df); its length is counted."""

    def __init__(self, table: DataFrame):
        self.table = table

    def __len__(self) -> int:
        return self.table.count()


def document_terms(docs: DataFrame, text: str = "processed", least: float = 1.0, most: float = 0.95):
    """(rows with tokens of two or more word characters and terms, vocabulary): terms are the tokens that ``least``
    documents have, and at most ``most`` of them; both are shares below 1, else counts. Neither terms nor the
    vocabulary pass through the driver, but for those that more than ``most`` of the documents have, of which there
    are few: each takes up a token of most documents."""
    rows = docs.withColumn("tokens", F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)))
    n = docs.count()
    low, high = (x if x >= 1 else x * n for x in (least, most))
    table = Stored(rows.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "vocabulary").df
    if most < 1:
        common = [r[0] for r in table.where(F.col("df") > high).select("term").collect()]
        rows = rows.withColumn("terms", F.filter("tokens", lambda t: ~t.isin(common)) if common else F.col("tokens"))
    if most >= 1 or low > 1:  # what goes has no bound
        kept = rows.select("id", F.explode("tokens").alias("term")).join(table.where(F.col("df").between(low, high)), "term", "left_semi")
        kept = kept.groupBy("id").agg(F.collect_list("term").alias("terms"))
        rows = rows.drop("terms").join(kept, "id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return rows, Vocabulary(table.where(F.col("df").between(low, high)))


def topic_terms(model: Topics, vocabulary: Vocabulary | None = None, n: int = 15) -> DataFrame:
    """(topic from 1, rank from 0, term) of each topic's first n terms; the model holds the terms, no vocabulary is read."""
    return nmf_terms(model.weights, n)


def joined_terms(shown: DataFrame) -> DataFrame:
    """topic and its terms in order, joined by ' | '."""
    terms = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " | ")
    return shown.groupBy("topic").agg(terms.alias("terms"))


def describe_topics(model: Topics, vocabulary: Vocabulary | None = None, n: int = 15) -> DataFrame:
    return joined_terms(topic_terms(model, vocabulary, n))


def nmf_terms(h: DataFrame, n: int = 15) -> DataFrame:
    """(topic from 1, rank from 0, term) of each factor's n heaviest terms; ``h`` as ``fit_nmf`` gives it."""
    each = h.select("term", F.posexplode("h").alias("t", "w")).select((F.col("t") + 1).alias("topic"), "term", "w")
    heavy = Window.partitionBy("topic").orderBy(F.desc("w"), "term")
    first = each.withColumn("place", F.row_number().over(heavy)).where(F.col("place") <= n)  # a limit on the place itself is applied before the shuffle too
    return first.select("topic", (F.col("place") - 1).alias("rank"), "term")


def term_weights(rows: DataFrame) -> DataFrame:
    """(id, term, tf) for NMF from tokens: counts times ln((1 + documents) / (1 + df)) + 1, of length 1 for each document."""
    counts = rows.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = rows.agg(F.count("*").alias("all"))
    own = counts.join(df, "term").crossJoin(F.broadcast(total))  # total: one row
    own = own.select("id", "term", (F.col("tf") * (F.ln((1 + F.col("all")) / (1 + F.col("df"))) + 1)).alias("w"))
    length = own.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return own.join(length, "id").select("id", "term", (F.col("w") / F.col("length")).alias("tf"))


def with_topics(model: Topics, rows: DataFrame) -> DataFrame:
    """Adds topic_mix (shares; zeros where there are no terms) and topic (the first largest, from 1)."""
    mixes = Stored(model.mixes(rows), "mixes").df
    none = F.array(*[F.lit(0.0)] * model.k)
    out = rows.join(mixes, "id", "left").withColumn("topic_mix", F.coalesce("topic_mix", none))
    return out.withColumn("topic", F.array_position("topic_mix", F.array_max("topic_mix")).cast("int"))


def of_topic(rows: DataFrame, topic: int) -> DataFrame:
    """The articles whose first topic it is."""
    return rows.where(F.col("topic") == topic)


def umass_coherence(topic_terms: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """coherence: mean over topics and pairs of their terms (later, earlier) of ln((D(both) + 1) / max(1, D(earlier))).

    topic_terms: topic, rank, term; doc_terms: distinct id, term. Only pairs that a document has are rows: the
    sum of the others' logarithms comes from how many later terms each one has.
    """
    found = Coded(doc_terms.join(topic_terms.select("term").distinct(), "term", "left_semi").select("id", F.col("term").alias("item")))
    single = doc_terms.groupBy("term").agg(F.count("*").alias("d"))
    placed = numbered(topic_terms.where("topic IS NOT NULL AND rank IS NOT NULL").select("topic", "rank", "term"), [F.desc("rank"), F.col("term")], ("topic",))
    later = placed.groupBy("topic", "rank").agg(F.min("position").alias("later"))
    own = placed.join(later, ["topic", "rank"]).join(single, "term", "left")
    below = own.agg(F.sum("later").alias("pairs"), F.sum(F.col("later") * F.ln(F.greatest(F.lit(1), zero(F.col("d"))))).alias("below"))
    coded = found.names.join(topic_terms, F.col("item") == F.col("term")).select("code", "topic", "rank")
    x, y = coded.toDF("src", "topic", "rx"), coded.toDF("dst", "topic_y", "ry")
    met = found.edges.join(sent(x, found.count), "src").join(sent(y, found.count), "dst").where("topic = topic_y AND rx <> ry")
    above = met.agg(F.sum(F.ln(F.col("weight") + 1)).alias("above"))
    return below.join(above, F.lit(True)).select(((zero(F.col("above")) - F.col("below")) / F.nullif(F.col("pairs"), F.lit(0))).alias("coherence"))  # one row each


def window_counts(topic_terms: DataFrame, docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(topic, x, y, both): sliding windows of ``size`` tokens that hold both terms of a topic, x = y for one term.

    docs: id, tokens. A place covers the windows that begin up to size - 1 tokens before it; a document that is no
    longer than a window is one. The windows that a term is in are bits of numbers, 64 to a block: the union of
    what its places cover is an or, what two terms share an and, so neither windows nor pairs of places are rows.
    """
    terms = topic_terms.select("topic", "term").distinct()
    rows = docs.select("id", F.greatest(F.size("tokens") - size, F.lit(0)).alias("last"), F.posexplode("tokens").alias("at", "term"))
    rows = rows.join(F.broadcast(terms), "term")  # some terms a topic
    rows = rows.withColumn("lo", F.greatest(F.col("at") - (size - 1), F.lit(0))).withColumn("hi", F.least("at", "last"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))))
    mask = "shiftleft(shiftrightunsigned(-1L, cast(63 - least(hi - 64 * block, 63) + greatest(lo - 64 * block, 0) as int)), cast(greatest(lo - 64 * block, 0) as int))"
    held = rows.groupBy("id", "block", "topic", "term").agg(F.bit_or(F.expr(mask)).alias("mask"))
    blocks = held.groupBy("id", "block", "topic").agg(F.sort_array(F.collect_list(F.struct("term", "mask"))).alias("a"))  # at most a topic's terms
    first = blocks.select("topic", "a", F.posexplode("a").alias("i", "x"))
    pairs = first.select("topic", "x", F.explode(F.slice("a", F.col("i") + 1, F.size("a"))).alias("y"))
    return pairs.groupBy("topic", F.col("x.term").alias("x"), F.col("y.term").alias("y")).agg(F.sum(F.bit_count(F.expr("x.mask & y.mask"))).alias("both"))


def cv_coherence(topic_terms: DataFrame, docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(topic, coherence): how alike the company is that a topic's terms keep.

    A term's vector has its normalized pointwise mutual information, over sliding windows, with each term of the
    topic (itself included); the coherence is the mean cosine of the terms' vectors and their sum. Terms that
    no document has give nothing to the others, and a cosine of 0. topic_terms: topic, term; docs: id, tokens.
    """
    both = window_counts(topic_terms, docs, size)
    total = docs.agg(F.sum(F.greatest(F.size("tokens") - size, F.lit(0)) + 1).alias("windows"))
    single = both.where("x = y").select("topic", F.col("x").alias("term"), F.col("both").alias("n"))
    every = both.unionByName(both.where("x <> y").select("topic", F.col("y").alias("x"), F.col("x").alias("y"), "both"))
    terms = topic_terms.select("topic", "term").distinct()
    cells = terms.toDF("topic", "x").join(terms.toDF("topic", "y"), "topic").join(every, ["topic", "x", "y"], "left")
    cells = cells.join(single.toDF("topic", "x", "nx"), ["topic", "x"]).join(single.toDF("topic", "y", "ny"), ["topic", "y"]).join(F.broadcast(total), F.lit(True))  # one row
    p = lambda c: zero(F.col(c)) / F.col("windows")
    cells = cells.select("topic", "x", "y", (F.ln((p("both") + EPSILON) / (p("nx") * p("ny"))) / -F.ln(p("both") + EPSILON)).alias("v"))
    whole = cells.groupBy("topic", "y").agg(F.sum("v").alias("s"))
    length = whole.groupBy("topic").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"))
    parts = cells.join(whole, ["topic", "y"]).groupBy("topic", "x").agg(F.sum(F.col("v") * F.col("s")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("own"))
    cosine = parts.join(length, "topic").select("topic", "x", (F.col("dot") / F.nullif(F.col("own") * F.col("length"), F.lit(0.0))).alias("cosine"))
    return terms.toDF("topic", "x").join(cosine, ["topic", "x"], "left").groupBy("topic").agg(F.avg(zero(F.col("cosine"))).alias("coherence"))


def time_slice(year: Column, width: int) -> Column:
    lo = (F.floor(year / width) * width).cast("int")
    return F.concat(lo.cast("string"), F.lit("-"), (lo + (width - 1)).cast("string"))


def slices(articles: DataFrame, width: int) -> DataFrame:
    """All slices from the first to the last year's."""
    lo = (F.floor(F.col("year") / width) * width).cast("int")
    ends = articles.where("year IS NOT NULL").agg(F.min(lo).alias("lo"), F.max(lo).alias("hi")).where("lo IS NOT NULL")
    return ends.select(F.explode(F.sequence("lo", "hi", F.lit(width))).alias("lo")).select(time_slice(F.col("lo"), width).alias("slice"))


def topic_evolution(rows: DataFrame, width: int, k: int) -> DataFrame:
    """Mean share of each topic in each slice; 0 in slices without documents."""
    n = rows.where("year IS NOT NULL").select(time_slice(F.col("year"), width).alias("slice"), F.posexplode("topic_mix").alias("i", "p"))
    n = n.groupBy("slice", (F.col("i") + 1).alias("topic")).agg(F.avg("p").alias("share"))
    topics = rows.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("topic"))
    return slices(rows, width).crossJoin(F.broadcast(topics)).join(n, ["slice", "topic"], "left").select("slice", "topic", zero(F.col("share")).alias("share"))  # k rows


def topic_counts(rows: DataFrame, width: int, k: int) -> DataFrame:
    n = rows.where("year IS NOT NULL").groupBy(time_slice(F.col("year"), width).alias("slice")).pivot("topic", list(range(1, k + 1))).count()
    return slices(rows, width).join(n, "slice", "left").na.fill(0)


def topic_impact(rows: DataFrame) -> DataFrame:
    return rows.groupBy("topic").agg(F.avg("mncs").alias("mean_mncs"), F.count("*").alias("n"))


def top_articles(rows: DataFrame, k: int = 1) -> DataFrame:
    """The k most cited articles of each topic."""
    w = Window.partitionBy("topic").orderBy(F.col("cites").desc_nulls_last(), "id")
    return rows.withColumn("r", F.row_number().over(w)).where(f"r <= {k}")


def activity_index(rows: DataFrame, least: int) -> DataFrame:
    """(country, topic, index): the topic's share in a country over its share in all country appearances."""
    n = rows.select(F.explode("countries").alias("country"), "topic").groupBy("country", "topic").agg(F.count("*").alias("n"))
    by_country, by_topic = n.groupBy("country").agg(F.sum("n").alias("nc")), n.groupBy("topic").agg(F.sum("n").alias("nt"))
    total = n.agg(F.sum("n").alias("total"))
    out = n.join(by_country.where(F.col("nc") >= least), "country").join(by_topic, "topic").crossJoin(F.broadcast(total))  # total: one row
    return out.select("country", "topic", (F.col("n") * F.col("total") / (F.col("nc") * F.col("nt"))).alias("index"))


def topic_cooccurrence(rows: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """(a, b, n) for all pairs of topics: documents where both have more than ``least``; 0 on the diagonal."""
    strong = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: F.element_at("topic_mix", i) > least)
    first = rows.select(strong.alias("s")).select("s", F.explode("s").alias("a"))
    n = first.select("a", F.explode("s").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    topics = rows.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("a"))
    grid = topics.crossJoin(topics.toDF("b"))  # k rows each
    return grid.join(n, ["a", "b"], "left").select("a", "b", zero(F.col("n")).alias("n"))
