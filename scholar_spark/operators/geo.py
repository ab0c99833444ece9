"""Country metrics. Articles have id, year, cites, mncs and countries (distinct names)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholar_spark.functions import text as X
from scholar_spark.operators.metrics import zero


def classification(articles: DataFrame) -> DataFrame:
    """Documents of no, one and several countries; three rows always."""
    names = articles.sparkSession.createDataFrame([("SCP",), ("MCP",), ("Unknown",)], "class string")
    n = articles.groupBy(X.size_class(F.col("countries")).alias("class")).agg(F.count("*").alias("n"))
    total = articles.agg(F.count("*").alias("total"))
    out = names.join(F.broadcast(n), "class", "left").crossJoin(F.broadcast(total))  # three rows and one
    return out.select("class", zero(F.col("n")).alias("n"), F.bround(100.0 * zero(F.col("n")) / F.nullif("total", F.lit(0)), 1).alias("pct"))


def country_table(articles: DataFrame) -> DataFrame:
    """For each country: articles (each counts fully), alone and shared, their shares, mean MNCS, citations; one shuffle."""
    rows = articles.select("cites", "mncs", F.size("countries").alias("k"), F.explode("countries").alias("country"))
    n = rows.groupBy("country").agg(
        F.count("*").alias("articles"), F.count_if(F.col("k") == 1).alias("scp"), F.count_if(F.col("k") > 1).alias("mcp"),
        F.avg("mncs").alias("mean_mncs"), zero(F.sum("cites")).cast("bigint").alias("cites"),
    )
    share = lambda c: F.bround(100.0 * F.col(c) / F.col("articles"), 1)
    return n.withColumn("scp_pct", share("scp")).withColumn("mcp_pct", share("mcp")).withColumn("mcp_ratio", F.col("mcp") / F.col("articles"))


def impact(table: DataFrame, min_papers: int, top: int) -> DataFrame:
    return table.where((F.col("articles") >= min_papers) & F.col("mean_mncs").isNotNull()).orderBy(F.desc("mean_mncs"), "country").limit(top)


def matrix(table: DataFrame, min_papers: int) -> DataFrame:
    """Countries with enough papers and a defined MNCS; median productivity and colour bounds (2nd and 98th percentile)."""
    kept = table.where((F.col("articles") >= min_papers) & F.col("mean_mncs").isNotNull())
    ends = kept.agg(F.percentile("articles", F.lit(0.5)).alias("median_articles"), F.percentile("cites", F.array(F.lit(0.02), F.lit(0.98))).alias("bounds"))
    return kept.crossJoin(F.broadcast(ends))  # ends: one row


def tiers(table: DataFrame) -> DataFrame:
    """Countries by quartile of their articles."""
    q = table.agg(F.percentile("articles", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    tier = F.when(F.col("articles") < F.col("q")[0], "Low").when(F.col("articles") < F.col("q")[1], "Medium").when(F.col("articles") < F.col("q")[2], "High").otherwise("Very High")
    return table.crossJoin(F.broadcast(q)).select("country", "articles", tier.alias("tier"))  # q: one row


def year_grid(articles: DataFrame) -> DataFrame:
    """Articles of every country in every year from the first to the last, with the country's rank in the year.

    The grid's size is countries times years, a few thousand rows whatever the corpus.
    """
    n = articles.where("year IS NOT NULL").select(F.col("year").cast("int").alias("year"), F.explode("countries").alias("country")).groupBy("year", "country").agg(F.count("*").alias("n"))
    years = n.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("year"))
    grid = n.select("country").distinct().crossJoin(F.broadcast(years)).join(n, ["year", "country"], "left").select("year", "country", zero(F.col("n")).alias("n"))
    return grid.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("n"), "country")))


def case_study(articles: DataFrame, country: str, top: int = 10) -> dict[str, DataFrame]:
    """Tables about one country: its place, peak year, yearly rank, partners, and frequencies of other columns."""
    from scholar_spark.operators.metrics import frequency

    table, grid = country_table(articles), year_grid(articles)
    place = table.select("country", F.row_number().over(Window.orderBy(F.desc("articles"), "country")).alias("place"))  # a row a country
    own = articles.where(F.array_contains("countries", country))
    peak = grid.where(F.col("country") == country).orderBy(F.desc("n"), "year").limit(1)
    levels = tiers(table)
    mine = levels.where(F.col("country") == country).select("tier")
    out = {
        "summary": table.where(F.col("country") == country).join(place, "country").join(levels.select("country", "tier"), "country"),
        "peak": peak,
        "timeline": grid.where(F.col("country") == country),
        "peers": levels.join(F.broadcast(mine), "tier", "left_semi").where(F.col("country") != country),
        "partners": frequency(own.select(F.explode("countries").alias("c")).where(F.col("c") != country), "c", top),
    }
    for name in ("source", "doc_type", "database", "conference"):
        if name in articles.columns:
            out[name] = frequency(own, name, top)
    kinds = dict(articles.dtypes)
    for name in ("institutions", "keywords", "funding"):
        if kinds.get(name, "").startswith("array"):
            out[name] = frequency(own.select(F.explode(name).alias("x")), "x", top)
    return out


def similar_names(table: DataFrame, asked: str) -> list[str]:
    """At most ten countries whose name contains what was asked, for an error text."""
    rows = table.where(F.lower("country").contains(asked.lower())).orderBy("country").limit(10)
    return [r["country"] for r in rows.collect()]


def top_cited(table: DataFrame, top: int) -> DataFrame:
    """The countries of most citations."""
    return table.orderBy(F.desc("cites"), "country").limit(top)


def labelled(table: DataFrame, articles: int = 15, others: int = 10) -> DataFrame:
    """The countries that a chart names, once each: most articles, largest mean impact, most citations."""
    by = lambda c, n: table.where(F.col(c).isNotNull()).orderBy(F.desc(c), "country").limit(n).select("country")
    return by("articles", articles).union(by("mean_mncs", others)).union(by("cites", others)).distinct()
