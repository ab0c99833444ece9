"""Corpus, author, source and citation metrics over an article table.

Articles have the columns id, year, cites, source, title, doc_type, authors (array), mncs as each operator
needs them. Nulls are missing values; sums over nothing are 0, means over nothing null.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholar_spark import schema as S
from scholar_spark.functions import text as X
from scholar_spark.operators.lineage import numbered


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def year_means(articles: DataFrame) -> DataFrame:
    """year, ref_size, ref_mean over articles with year and citations."""
    known = articles.where("year IS NOT NULL")
    return known.groupBy("year").agg(F.count("cites").alias("ref_size"), F.avg("cites").alias("ref_mean"))


def add_mncs(articles: DataFrame) -> DataFrame:
    """Adds ref_mean, ref_size, mncs and mncs_defined: citations over the mean of the same year.

    The years' means are aggregated first (a row a year, map-side combined) and joined back; a window over
    the year would put a whole year into one task.
    """
    out = articles.join(year_means(articles), "year", "left")  # a row a year: sent to all by its size at run time
    defined = F.col("cites").isNotNull() & (F.col("ref_mean") > 0)
    return out.withColumn("mncs", F.when(defined, F.col("cites") / F.col("ref_mean"))).withColumn("mncs_defined", F.coalesce(defined, F.lit(False)))


def mncs_baselines(articles: DataFrame) -> DataFrame:
    known = articles.where("year IS NOT NULL").groupBy("year").agg(
        F.count("cites").alias("n"), F.avg("cites").alias("mean"), F.percentile("cites", 0.5).alias("median"), zero(F.sum("cites")).alias("total")
    )
    return known.where("n > 0").withColumn("zero_mean", F.col("mean") == 0)


def mncs_audit(with_mncs: DataFrame) -> DataFrame:
    return with_mncs.agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("mncs_defined")).alias("n_defined"),
        F.count_if(F.col("cites").isNull()).alias("n_no_cites"),
        F.count_if(F.col("year").isNull()).alias("n_no_year"),
        F.count_distinct(F.when(F.col("ref_mean") == 0, F.col("year"))).alias("n_zero_mean_years"),
    )


def spine(yearly: DataFrame, year: str = "year") -> DataFrame:
    """Every year from the first to the last; ``yearly`` has a row a year."""
    ends = yearly.agg(F.min(year).cast("int").alias("lo"), F.max(year).cast("int").alias("hi")).where("lo IS NOT NULL")
    return ends.select(F.explode(F.sequence("lo", "hi")).alias(year))


def annual_production(articles: DataFrame) -> DataFrame:
    """Articles a year, 0 in the gaps."""
    n = articles.where("year IS NOT NULL").groupBy(F.col("year").cast("int").alias("year")).agg(F.count("*").alias("n"))
    return spine(n).join(n, "year", "left").select("year", zero(F.col("n")).alias("n"))


def trend(yearly: DataFrame, x: str = "year", y: str = "n") -> DataFrame:
    """Slope, intercept, r2, standard error and growth of a yearly series; r2 0 for a flat one."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return yearly.agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.when(F.regr_syy(b, a) == 0, 0.0).otherwise(F.regr_r2(b, a)).alias("r2"),
        F.sqrt(F.greatest(F.try_divide(F.try_divide(F.regr_syy(b, a) - F.pow(F.regr_sxy(b, a), F.lit(2)) / F.nullif(F.regr_sxx(b, a), F.lit(0)), F.nullif(F.count("*") - 2, F.lit(0))), F.nullif(F.regr_sxx(b, a), F.lit(0))), F.lit(0.0))).alias("stderr"),
        F.count("*").alias("n"),
        cagr(F.min_by(b, a), F.max_by(b, a), F.max(a) - F.min(a)).alias("cagr"),
    )


def trend_test(fitted: DataFrame) -> DataFrame:
    """The one row of ``trend`` with p_value: two-sided, that the slope is 0."""

    @F.pandas_udf("double")
    def p(slope: pd.Series, error: pd.Series, n: pd.Series) -> pd.Series:
        t = [math.inf if e == 0 and b else math.nan if not e or e != e else b / e for b, e in zip(slope, error)]
        return pd.Series([0.0 if math.isinf(x) else t_two_sided(x, int(k) - 2) for x, k in zip(t, n)])

    return fitted.withColumn("p_value", F.nullif(p("slope", "stderr", "n"), F.lit(float("nan"))))


def cagr(first: Column, last: Column, years: Column) -> Column:
    """(last / first) ** (1 / years) - 1; null where first or years is not positive."""
    return F.when((first > 0) & (years > 0), F.pow(F.try_divide(last, first), F.try_divide(F.lit(1.0), years)) - 1)


def t_two_sided(t: float, df: int) -> float:
    """Two-sided p-value of Student's t by the regularized incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return math.nan
    x = df / (df + t * t)
    return _beta(df / 2, 0.5, x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + k * d or 1e-300)
        c = 1 + k / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1) if f > 1 else front * f


def corpus_characteristics(articles: DataFrame, as_of: int) -> DataFrame:
    """One row: documents, years, growth, r2 of the timeline, mean age, sources, citations, references."""
    one = articles.agg(
        F.count("*").alias("documents"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.avg(F.lit(as_of) - F.col("year")).alias("mean_age"),
        F.count_distinct("source").alias("sources"),
        F.avg(zero(F.col("cites"))).alias("mean_cites"),
        *([zero(F.sum("refs")).alias("references")] if "refs" in articles.columns else []),
    )
    return one.crossJoin(trend(annual_production(articles)).select("r2", (100 * F.col("cagr")).alias("growth_pct")))  # one row each


def citation_dynamics(articles: DataFrame, cutoff: int) -> DataFrame:
    """Mean citations and articles for each year, age and citations a year of age; gaps stay null."""
    y = articles.where("year IS NOT NULL").groupBy(F.col("year").cast("int").alias("year")).agg(F.avg("cites").alias("mean_cites"), F.count("*").alias("n"))
    age = F.lit(cutoff) - F.col("year") + 0.5
    return spine(y).join(y, "year", "left").select("year", "mean_cites", zero(F.col("n")).alias("n"), age.alias("age"), (F.col("mean_cites") / age).alias("mean_annual"))


def doc_types(articles: DataFrame) -> DataFrame:
    """Documents for each normal type; the share is of documents, so shares may add up to more than 100."""
    total = articles.agg(F.count("*").alias("total"))
    parts = articles.select(F.explode(F.split(F.coalesce("doc_type", F.lit(S.NO_TYPE)), "; ")).alias("t"))
    n = parts.groupBy(X.doc_type(F.col("t")).alias("type")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("type", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))  # total: one row


def h_index(df: DataFrame, by: list[str], cites: str = "cites") -> DataFrame:
    """h and g for each group.

    Neither exceeds the root of the group's citations (nor h its articles), so articles are first counted by
    citation value, which a group has few of however many articles it has: the window runs over values.
    """
    values = df.select(*by, zero(F.col(cites)).cast("bigint").alias("c")).groupBy(*by, "c").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by).orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    run = values.withColumn("n", F.sum("k").over(w)).withColumn("s", F.sum(F.col("c") * F.col("k")).over(w))
    # among the articles of one value the rank goes from n - k + 1 to n
    h = F.least(F.col("c"), F.col("n"))
    reach = F.when(h >= F.col("n") - F.col("k") + 1, h).otherwise(0)
    # g: largest g in that range with s - (n - g) c >= g^2
    q = F.col("s") - F.col("n") * F.col("c")
    root = F.floor((F.col("c") + F.sqrt((F.col("c") * F.col("c") + 4 * q).cast("double"))) / 2)
    g = F.least(root, F.col("n"))
    top = F.when(F.col("c") * F.col("c") + 4 * q < 0, 0).when(g >= F.col("n") - F.col("k") + 1, g).otherwise(0)
    return run.groupBy(*by).agg(F.max(reach).cast("bigint").alias("h"), F.max(top).cast("bigint").alias("g"))


def modal(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of several."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    return n.groupBy(*by).agg(F.min_by(value, F.struct((-F.col("k")).alias("a"), F.col(value).alias("b"))).alias(value))


def source_titles(articles: DataFrame, spelled: str, longest: int = 40, by: str = "source") -> DataFrame:
    """For each source its most frequent spelling as a journal title, and that cut to ``longest`` characters."""
    known = articles.where(F.col(by).isNotNull() & F.col("year").isNotNull())
    title = X.journal_title(F.col(spelled))
    return modal(known, [by], spelled).select(by, title.alias("title")).withColumn("display", X.truncate(F.col("title"), longest))


def source_metrics(articles: DataFrame, as_of: int, by: str = "source") -> DataFrame:
    """For each source: articles, citations, mean MNCS, first year, years active, h, g and m index."""
    known = articles.where(F.col(by).isNotNull() & F.col("year").isNotNull())
    n = known.groupBy(by).agg(
        F.count("*").alias("n"), zero(F.sum("cites")).cast("bigint").alias("cites"), F.avg("mncs").alias("mean_mncs"), F.min("year").cast("int").alias("first_year")
    )
    years = F.greatest(F.lit(1), F.lit(as_of) - F.col("first_year") + 1)
    out = n.join(h_index(known, [by]), by)
    return out.withColumn("years_active", years).withColumn("m", F.col("h") / F.col("years_active"))


def source_rankings(metrics: DataFrame, min_papers: int, top: int = 10, by: str = "source") -> dict[str, DataFrame]:
    tops = {k: metrics.orderBy(F.desc(c), F.desc("n"), by).limit(top) for k, c in (("volume", "n"), ("h", "h"), ("g", "g"), ("m", "m"))}
    rated = metrics.where((F.col("n") >= min_papers) & F.col("mean_mncs").isNotNull())
    return tops | {"impact": rated.orderBy(F.desc("mean_mncs"), F.desc("h"), by).limit(top)}


def bradford(articles: DataFrame, by: str = "source") -> DataFrame:
    """Sources by articles with rank, running total, ln(rank) and zone (up to a third, two thirds, the rest).

    The running total over sources is taken in two steps: sources fall into ordered chunks by their count,
    so the one-task window only sees distinct counts, not sources.
    """
    n = articles.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    per = n.groupBy("n").agg(F.count("*").alias("k"))
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("n", zero(F.sum("k").over(before)).alias("ahead"), zero(F.sum(F.col("k") * F.col("n")).over(before)).alias("articles_ahead"))
    total = n.agg(F.sum("n").alias("total"))
    inner = Window.partitionBy("n").orderBy(by)
    out = n.withColumn("i", F.row_number().over(inner)).join(per, "n").crossJoin(F.broadcast(total))  # total: one row
    running = (F.col("articles_ahead") + F.col("i") * F.col("n")).cast("bigint")
    out = out.select(by, "n", (F.col("ahead") + F.col("i")).cast("bigint").alias("rank"), running.alias("running"), "total")
    zone = F.when(3 * F.col("running") <= F.col("total"), 1).when(3 * F.col("running") <= 2 * F.col("total"), 2).otherwise(3)
    return out.select(by, "n", "rank", "running", F.ln("rank").alias("log_rank"), zone.alias("zone"))


def bradford_zones(ranked: DataFrame) -> DataFrame:
    """Sources and articles of the three zones, all three always."""
    zones = ranked.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("zone"))
    n = ranked.groupBy("zone").agg(F.count("*").alias("sources"), F.sum("n").alias("articles"))
    return zones.join(F.broadcast(n), "zone", "left").select("zone", zero(F.col("sources")).alias("sources"), zero(F.col("articles")).alias("articles"))


def author_productivity(articles: DataFrame) -> DataFrame:
    """For each author: papers (list entries), citations, fractional credit, mean MNCS."""
    rows = articles.select("cites", "mncs", F.size("authors").alias("k"), F.explode("authors").alias("author"))
    return rows.groupBy("author").agg(
        F.count("*").alias("papers"), zero(F.sum("cites")).cast("bigint").alias("cites"), F.sum(1.0 / F.col("k")).alias("credit"), F.avg("mncs").alias("mean_mncs")
    )


def author_impact(articles: DataFrame, top: int | None = None) -> DataFrame:
    """For each author: papers, citations and h index; with ``top``, the first by h, citations, papers."""
    rows = articles.select("cites", F.explode("authors").alias("author"))
    n = rows.groupBy("author").agg(F.count("*").alias("papers"), zero(F.sum("cites")).cast("bigint").alias("cites"))
    out = n.join(h_index(rows, ["author"]).drop("g"), "author")
    return out if top is None else out.orderBy(F.desc("h"), F.desc("cites"), F.desc("papers"), "author").limit(top)


def team_size(articles: DataFrame) -> DataFrame:
    """Mean citations and documents for teams of 1 to 5 and 6 or more; six rows always."""
    n = articles.where(F.size("authors") > 0).groupBy(F.least(F.size("authors"), F.lit(6)).alias("team")).agg(F.avg(zero(F.col("cites"))).alias("mean_cites"), F.count("*").alias("n"))
    teams = articles.sparkSession.range(1, 7).select(F.col("id").cast("int").alias("team"))
    label = F.when(F.col("team") == 6, "6+").otherwise(F.col("team").cast("string"))
    return teams.join(F.broadcast(n), "team", "left").select(label.alias("team"), "mean_cites", zero(F.col("n")).alias("n"))


def landscape(articles: DataFrame, by: str = "source") -> DataFrame:
    n = articles.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), zero(F.sum("cites")).cast("bigint").alias("cites"))
    return n.where("cites > 0").withColumn("avg_cites", F.col("cites") / F.col("n"))


def article_ranks(articles: DataFrame) -> DataFrame:
    """All articles with their rank by citations, of equals in the order of ids; numbered in ranges."""
    out = numbered(articles.withColumn("cites", zero(F.col("cites"))), [F.desc("cites"), F.col("id")])
    return out.withColumn("rank", F.col("position") + 1).drop("position")


def article_ranking(articles: DataFrame, top: int) -> DataFrame:
    """The ``top`` most cited articles with their rank, and how a table shows title and first author."""
    first = articles.withColumn("cites", zero(F.col("cites"))).orderBy(F.desc("cites"), "id").limit(top)
    if "Title" in articles.columns:
        author = F.coalesce(F.get("authors", F.lit(0)), F.lit("N/A")) if "authors" in articles.columns else F.lit("N/A")
        first = first.withColumn("short_title", X.truncate(F.col("Title"), 70)).withColumn("first_author", author)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cites"), "id")))  # over the top rows only


def hot_papers(articles: DataFrame, as_of: int, top: int) -> DataFrame:
    return article_ranking(articles.where(F.col("year") >= as_of - 3), top)


def final_summary(articles: DataFrame, as_of: int) -> DataFrame:
    """One row of descriptors of the whole corpus; the mean of authors leaves out documents without any.

    References and unique keywords are there if ``articles`` has refs, keywords (an array) or index_keywords.
    """
    n, year, has = F.size("authors"), F.col("year").cast("int"), articles.columns
    ends = articles.agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    near = articles.join(F.broadcast(ends), (year == F.col("lo")) | (year == F.col("hi"))).groupBy("lo", "hi").agg(  # ends: one row
        F.count_if(year == F.col("lo")).alias("first"), F.count_if(year == F.col("hi")).alias("last")
    )
    growth = near.agg(F.first(100 * cagr(F.col("first").cast("double"), F.col("last").cast("double"), F.col("hi") - F.col("lo"))).alias("growth_pct"))
    base = articles.agg(
        F.count("*").alias("documents"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.avg(F.lit(as_of) - F.col("year")).alias("mean_age"),
        F.count_distinct("source").alias("sources"),
        F.avg(zero(F.col("cites"))).alias("mean_cites"),
        zero(F.sum("cites")).cast("bigint").alias("total_cites"),
        F.avg(F.when(n > 0, n)).alias("authors_per_document"),
        F.count_if(n == 1).alias("single_authored"),
        *([(100.0 * F.count_if(F.size("countries") > 1) / F.nullif(F.count("*"), F.lit(0))).alias("international_pct")] if "countries" in has else []),
        *([zero(F.sum("refs")).cast("bigint").alias("references")] if "refs" in has else []),
    )
    counted = [("authors", "authors")] + [(c, f"unique_{c}") for c in ("keywords", "index_keywords") if dict(articles.dtypes).get(c) == "array<string>"]
    for c, name in counted:
        base = base.crossJoin(articles.select(F.explode(c).alias("x")).agg(F.count_distinct(F.lower("x") if c != "authors" else "x").alias(name)))  # one row each
    return base.crossJoin(growth)


def document_snapshot(articles: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent document types as they are written in lower case, with their normal form."""
    kinds = articles.select(F.explode(F.split(F.lower("doc_type"), ";")).alias("t")).select(X.strip(F.col("t")).alias("doc_type"))
    n = kinds.groupBy("doc_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_type").limit(top)
    return n.withColumn("normal", X.doc_type(F.col("doc_type")))


def frequency(df: DataFrame, item: str, top: int) -> DataFrame:
    x = X.strip(F.col(item).cast("string"))
    n = df.select(x.alias("item")).where("item IS NOT NULL AND item <> '' AND lower(item) <> 'nan'").groupBy("item").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "item").limit(top)
