"""The bibliometric operators as named queries over the driver tables, with their SQL for DuckDB.

An order is an article, its customer the source, its suppliers the authors and institutions, their nations
(under country names) the countries.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholar_spark.functions import text as X
from scholar_spark.operators import centrality, communities, entities, geo, graph, lineage, linkage, metrics, themes, validation

AS_OF = 2002
#: Names for the 25 nations: 15 of the EU, 10 others.
NATIONS = (
    "Austria Belgium Bulgaria Croatia Denmark Estonia Finland France Germany Greece Hungary Ireland Italy Latvia Spain "
    "Brazil Canada Chile China India Japan Mexico Norway Peru Switzerland"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, author, country) for each supplier of an order."""
    names = F.array(*[F.lit(n) for n in NATIONS])
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("author"), F.element_at(names, F.col("s_nationkey") + 1).alias("country"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("id", "author", "country")


def articles(spark: SparkSession, sf_dir: str, lists: bool = True, mncs: bool = True) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kinds = {"1-URGENT": "Article", "2-HIGH": "Review; Book", "3-MEDIUM": "Conference Paper", "5-LOW": "Proceedings Paper"}
    out = o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 41 != 0, F.year("o_orderdate")).alias("year"),
        F.when(F.col("o_orderkey") % 17 != 0, F.floor(F.col("o_totalprice") / 20000)).alias("cites"),
        X.lookup(F.col("o_orderpriority"), kinds).alias("doc_type"),
        "o_custkey",
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("source"), F.col("c_mktsegment").alias("keywords"))
    out = out.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey", "c_custkey")
    if mncs:
        out = metrics.add_mncs(out)
    if lists:
        a = appearances(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_set("author")).alias("authors"), F.array_sort(F.collect_set("country")).alias("countries"))
        none = F.array().cast("array<string>")
        out = out.join(a, "id", "left").withColumn("authors", F.coalesce("authors", none)).withColumn("countries", F.coalesce("countries", none))
    return out


def with_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a made-up mix of four topics."""
    raw = [(F.col("id") * (7 * i + 3) + i) % 10 + 1 for i in range(4)]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    rows = articles(spark, sf_dir).withColumn("topic_mix", F.array(*[x / total for x in raw]))
    return rows.withColumn("topic", F.array_position("topic_mix", F.array_max("topic_mix")).cast("int"))


_names = "[" + ", ".join(f"'{n}'" for n in NATIONS) + "]"
BASE = f"""
WITH ap AS (
  SELECT DISTINCT l_orderkey AS id, s_name AS author, list_extract({_names}, s_nationkey + 1) AS country
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), lists AS (
  SELECT id, list_sort(list(DISTINCT author)) AS authors, list_sort(list(DISTINCT country)) AS countries FROM ap GROUP BY id
), art0 AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 41 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice / 20000) AS BIGINT) END AS cites,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Article' WHEN '2-HIGH' THEN 'Review; Book' WHEN '3-MEDIUM' THEN 'Conference Paper'
      WHEN '5-LOW' THEN 'Proceedings Paper' END AS doc_type,
    c_name AS source, c_mktsegment AS keywords, coalesce(authors, []) AS authors, coalesce(countries, []) AS countries
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lists ON lists.id = o_orderkey
), ym AS (SELECT year, count(cites) AS ref_size, avg(cites) AS ref_mean FROM art0 WHERE year IS NOT NULL GROUP BY year
), art AS (
  SELECT art0.*, ref_size, ref_mean, CASE WHEN cites IS NOT NULL AND ref_mean > 0 THEN cites / ref_mean END AS mncs,
    coalesce(cites IS NOT NULL AND ref_mean > 0, false) AS mncs_defined
  FROM art0 LEFT JOIN ym ON art0.year = ym.year
)"""
TOPICS = ", raw AS (SELECT *, [" + ", ".join(f"(id * {7 * i + 3} + {i}) % 10 + 1" for i in range(4)) + """] AS r FROM art),
mix AS (SELECT *, list_transform(r, lambda x: x / list_sum(r)) AS topic_mix, CAST(list_position(r, list_max(r)) AS INTEGER) AS topic FROM raw)"""
PAIRS = """, e AS (
  SELECT x.{c} AS src, y.{c} AS dst, count(*) AS weight FROM (SELECT DISTINCT id, {c} FROM ap) x JOIN (SELECT DISTINCT id, {c} FROM ap) y
  ON x.id = y.id AND x.{c} < y.{c} GROUP BY ALL), m AS (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"""
H = """, v AS (SELECT {by} AS k, coalesce(cites, 0) AS c, row_number() OVER (PARTITION BY {by} ORDER BY coalesce(cites, 0) DESC, id) AS r,
  sum(coalesce(cites, 0)) OVER (PARTITION BY {by} ORDER BY coalesce(cites, 0) DESC, id) AS s FROM {rows}),
hg AS (SELECT k, count(*) FILTER (c >= r) AS h, count(*) FILTER (s >= r * r) AS g FROM v GROUP BY k)"""

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True, recursive: bool = False):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = (BASE.replace("WITH", "WITH RECURSIVE", 1) if recursive else BASE if base else "") + sql

        @wraps(f)
        def same(*a):
            return f(*a)

        return same

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@query(" SELECT id, round(mncs, 6) AS mncs, mncs_defined, ref_size FROM art")
def mncs(spark, d):
    return rounded(articles(spark, d, lists=False).select("id", "mncs", "mncs_defined", "ref_size"), "mncs")


@query(""" SELECT year, count(cites) AS n, round(avg(cites), 6) AS mean, quantile_cont(cites, 0.5) AS median, CAST(coalesce(sum(cites), 0) AS BIGINT) AS total,
  avg(cites) = 0 AS zero_mean FROM art WHERE year IS NOT NULL GROUP BY year HAVING count(cites) > 0""")
def mncs_baselines(spark, d):
    return rounded(metrics.mncs_baselines(articles(spark, d, False, False)), "mean")


@query(""" SELECT count(*) AS n_documents, count(*) FILTER (mncs_defined) AS n_defined, count(*) FILTER (cites IS NULL) AS n_no_cites,
  count(*) FILTER (year IS NULL) AS n_no_year, count(DISTINCT year) FILTER (ref_mean = 0) AS n_zero_mean_years FROM art""")
def mncs_audit(spark, d):
    return metrics.mncs_audit(articles(spark, d, False))


_SPINE = """, y AS (SELECT year, count(*) AS n FROM art WHERE year IS NOT NULL GROUP BY year),
sp AS (SELECT s.year, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(min(year), max(year))) AS INTEGER) AS year FROM y) s LEFT JOIN y ON y.year = s.year)"""
_TREND = """round(regr_slope(n, year), 6) AS slope, round(regr_intercept(n, year), 6) AS intercept,
  round(CASE WHEN regr_syy(n, year) = 0 THEN 0 ELSE regr_r2(n, year) END, 6) AS r2,
  round(sqrt((regr_syy(n, year) - regr_sxy(n, year) ** 2 / regr_sxx(n, year)) / (count(*) - 2) / regr_sxx(n, year)), 6) AS stderr, count(*) AS n,
  round((max_by(n, year) / min_by(n, year)) ** (1.0 / (max(year) - min(year))) - 1, 6) AS cagr"""


@query(_SPINE + " SELECT year, n FROM sp")
def annual_production(spark, d):
    return metrics.annual_production(articles(spark, d, False, False))


@query(_SPINE + f" SELECT {_TREND} FROM sp")
def trend_regression(spark, d):
    return rounded(metrics.trend(metrics.annual_production(articles(spark, d, False, False))), "slope", "intercept", "r2", "stderr", "cagr")


@query(_SPINE + f""", t AS (SELECT {_TREND} FROM sp) SELECT count(*) AS documents, min(year) AS first_year, max(year) AS last_year, round(avg({AS_OF} - year), 6) AS mean_age,
  count(DISTINCT source) AS sources, round(avg(coalesce(cites, 0)), 6) AS mean_cites, (SELECT r2 FROM t) AS r2, (SELECT round(100 * ((max_by(n, year) / min_by(n, year)) ** (1.0 / (max(year) - min(year))) - 1), 6) FROM sp) AS growth_pct FROM art""")
def corpus_characteristics(spark, d):
    return rounded(metrics.corpus_characteristics(articles(spark, d, False, False), AS_OF), "mean_age", "mean_cites", "r2", "growth_pct")


@query(f""", y AS (SELECT year, avg(cites) AS m, count(*) AS n FROM art WHERE year IS NOT NULL GROUP BY year)
  SELECT s.year, round(m, 6) AS mean_cites, coalesce(n, 0) AS n, CAST({AS_OF} - s.year + 0.5 AS DOUBLE) AS age, round(m / ({AS_OF} - s.year + 0.5), 6) AS mean_annual
  FROM (SELECT CAST(unnest(generate_series(min(year), max(year))) AS INTEGER) AS year FROM y) s LEFT JOIN y ON y.year = s.year""")
def citation_dynamics(spark, d):
    out = metrics.citation_dynamics(articles(spark, d, False, False), AS_OF)
    return rounded(out.withColumn("age", F.col("age").cast("double")), "mean_cites", "mean_annual")


@query(""", p AS (SELECT unnest(string_split(coalesce(doc_type, 'Missing/Incomplete data'), '; ')) AS t FROM art)
  SELECT CASE lower(t) WHEN 'article' THEN 'Article' WHEN 'review' THEN 'Review' WHEN 'book' THEN 'Book' WHEN 'conference paper' THEN 'Conference' ELSE 'Other' END AS type,
  count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM art), 6) AS pct FROM p GROUP BY 1""")
def doc_types(spark, d):
    return rounded(metrics.doc_types(articles(spark, d, False, False)), "pct")


_AUTH = ", rows AS (SELECT id, cites, mncs, len(authors) AS k, unnest(authors) AS author FROM art)"


@query(_AUTH + """ SELECT author, count(*) AS papers, CAST(coalesce(sum(cites), 0) AS BIGINT) AS cites, round(sum(1.0 / k), 6) AS credit, round(avg(mncs), 6) AS mean_mncs FROM rows GROUP BY author""")
def author_productivity(spark, d):
    return rounded(metrics.author_productivity(articles(spark, d)), "credit", "mean_mncs")


@query(_AUTH + H.format(by="author", rows="rows") + """ SELECT author, count(*) AS papers, CAST(coalesce(sum(cites), 0) AS BIGINT) AS cites, any_value(h) AS h FROM rows JOIN hg ON k = author
  GROUP BY author""".replace("JOIN hg ON k = author", "JOIN hg ON hg.k = author"))
def author_impact_h(spark, d):
    return metrics.author_impact(articles(spark, d, mncs=False))


_SRC = H.format(by="source", rows="(SELECT * FROM art WHERE source IS NOT NULL AND year IS NOT NULL)") + f""", sm AS (
  SELECT source, count(*) AS n, CAST(coalesce(sum(cites), 0) AS BIGINT) AS cites, avg(mncs) AS mean_mncs, min(year) AS first_year, any_value(h) AS h, any_value(g) AS g,
  greatest(1, {AS_OF} - min(year) + 1) AS years_active FROM art JOIN hg ON k = source WHERE year IS NOT NULL GROUP BY source)"""
_SRC_COLUMNS = "source, n, cites, round(mean_mncs, 6) AS mean_mncs, first_year, h, g, years_active, round(h / years_active, 6) AS m"


@query(_SRC + f" SELECT {_SRC_COLUMNS} FROM sm")
def source_metrics(spark, d):
    return rounded(metrics.source_metrics(articles(spark, d, False), AS_OF), "mean_mncs", "m")


@query(_SRC + f" SELECT {_SRC_COLUMNS} FROM sm ORDER BY h DESC, n DESC, source LIMIT 10")
def source_top_h(spark, d):
    found = metrics.source_metrics(articles(spark, d, False), AS_OF)
    return rounded(metrics.source_rankings(found, 5)["h"], "mean_mncs", "m")


@query(_SRC + f" SELECT {_SRC_COLUMNS} FROM sm WHERE n >= 5 AND mean_mncs IS NOT NULL ORDER BY sm.mean_mncs DESC, h DESC, source LIMIT 10")
def source_top_impact(spark, d):
    found = metrics.source_metrics(articles(spark, d, False), AS_OF)
    return rounded(metrics.source_rankings(found, 5)["impact"], "mean_mncs", "m")


_BRAD = """, b AS (SELECT source, count(*) AS n FROM art WHERE source IS NOT NULL GROUP BY source),
br AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS rank, CAST(sum(n) OVER (ORDER BY n DESC, source) AS BIGINT) AS running, sum(n) OVER () AS total FROM b),
z AS (SELECT *, CASE WHEN 3 * running <= total THEN 1 WHEN 3 * running <= 2 * total THEN 2 ELSE 3 END AS zone FROM br)"""


@query(_BRAD + " SELECT source, n, rank, running, round(ln(rank), 6) AS log_rank, zone FROM z")
def bradford(spark, d):
    return rounded(metrics.bradford(articles(spark, d, False, False)), "log_rank")


@query(_BRAD + " SELECT zone, count(source) AS sources, CAST(coalesce(sum(n), 0) AS BIGINT) AS articles FROM (SELECT unnest([1, 2, 3]) AS zone) q LEFT JOIN z USING (zone) GROUP BY zone")
def bradford_zones(spark, d):
    return metrics.bradford_zones(metrics.bradford(articles(spark, d, False, False)))


_RANK = " SELECT id, coalesce(cites, 0) AS cites, row_number() OVER (ORDER BY coalesce(cites, 0) DESC, id) AS rank FROM art {w} ORDER BY rank LIMIT 10"


@query(_RANK.format(w=""))
def article_rank(spark, d):
    return metrics.article_ranking(articles(spark, d, False, False), 10).select("id", "cites", F.col("rank").cast("bigint").alias("rank"))


@query(" SELECT id, coalesce(cites, 0) AS cites, row_number() OVER (ORDER BY coalesce(cites, 0) DESC, id) AS rank FROM art")
def article_ranks(spark, d):
    return metrics.article_ranks(articles(spark, d, False, False)).select("id", "cites", "rank")


@query(""", t AS (SELECT id, coalesce(cites, 0) AS cites, authors, concat_ws(' ', 'The report number', id, 'from', source, 'about', keywords, 'and', doc_type) AS title FROM art)
  SELECT row_number() OVER (ORDER BY cites DESC, id) AS rank, id, CASE WHEN length(title) > 70 THEN title[1:70] || '...' ELSE title END AS short_title, coalesce(authors[1], 'N/A') AS first_author
  FROM t ORDER BY rank LIMIT 40""")
def article_display(spark, d):
    title = F.concat_ws(" ", F.lit("The report number"), "id", F.lit("from"), "source", F.lit("about"), "keywords", F.lit("and"), "doc_type")
    rows = metrics.article_ranking(articles(spark, d, mncs=False).withColumn("Title", title), 40)
    return rows.select(F.col("rank").cast("bigint").alias("rank"), "id", "short_title", "first_author")


_SPELLED = "CASE WHEN id % 5 < 2 THEN upper(s) WHEN id % 5 < 4 THEN s ELSE lower(s) END"


@query(f""", t AS (SELECT s, {_SPELLED} AS spelled FROM (SELECT id, year, keywords AS s FROM art) WHERE s IS NOT NULL AND year IS NOT NULL),
  n AS (SELECT s, spelled, count(*) AS k FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k DESC, spelled) AS r FROM n) SELECT s AS source, spelled FROM r WHERE r = 1""")
def source_spelling(spark, d):
    rows = articles(spark, d, False, False).withColumn("s", F.col("keywords")).withColumn("spelled", F.expr(_SPELLED)).where("s IS NOT NULL AND year IS NOT NULL")
    return metrics.modal(rows, ["s"], "spelled").select(F.col("s").alias("source"), "spelled")


@query(_RANK.format(w=f"WHERE year >= {AS_OF - 3}"))
def hot_papers(spark, d):
    return metrics.hot_papers(articles(spark, d, False, False), AS_OF, 10).select("id", "cites", F.col("rank").cast("bigint").alias("rank"))


@query(""", t AS (SELECT least(len(authors), 6) AS t, avg(coalesce(cites, 0)) AS m, count(*) AS n FROM art WHERE len(authors) > 0 GROUP BY 1)
  SELECT CASE q WHEN 6 THEN '6+' ELSE CAST(q AS VARCHAR) END AS team, round(m, 6) AS mean_cites, coalesce(n, 0) AS n FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS q) LEFT JOIN t ON t = q""")
def team_size(spark, d):
    return rounded(metrics.team_size(articles(spark, d, mncs=False)), "mean_cites")


@query(""" SELECT source, count(*) AS n, CAST(sum(cites) AS BIGINT) AS cites, round(sum(cites) / count(*), 6) AS avg_cites FROM art WHERE source IS NOT NULL GROUP BY source HAVING coalesce(sum(cites), 0) > 0""")
def landscape(spark, d):
    return rounded(metrics.landscape(articles(spark, d, False, False)), "avg_cites")


@query(f""" SELECT count(*) AS documents, min(year) AS first_year, max(year) AS last_year, round(avg({AS_OF} - year), 6) AS mean_age, count(DISTINCT source) AS sources,
  round(avg(coalesce(cites, 0)), 6) AS mean_cites, CAST(coalesce(sum(cites), 0) AS BIGINT) AS total_cites, round(avg(len(authors)) FILTER (len(authors) > 0), 6) AS authors_per_document,
  count(*) FILTER (len(authors) = 1) AS single_authored, round(100.0 * count(*) FILTER (len(countries) > 1) / count(*), 6) AS international_pct,
  (SELECT count(DISTINCT author) FROM ap JOIN orders ON id = o_orderkey) AS authors,
  round(100.0 * (power(CAST(count(*) FILTER (year = (SELECT max(year) FROM art)) AS DOUBLE) / count(*) FILTER (year = (SELECT min(year) FROM art)), 1.0 / (max(year) - min(year))) - 1), 6) AS growth_pct FROM art""")
def final_summary(spark, d):
    return rounded(metrics.final_summary(articles(spark, d, mncs=False), AS_OF), "mean_age", "mean_cites", "authors_per_document", "international_pct", "growth_pct")


@query(""" SELECT trim(k) AS doc_type, count(*) AS n FROM (SELECT unnest(string_split(lower(doc_type), ';')) AS k FROM art) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""")
def document_snapshot(spark, d):
    return metrics.document_snapshot(articles(spark, d, False, False)).select("doc_type", "n")


@query(TOPICS + " SELECT topic, author AS item, count(*) AS n FROM mix JOIN (SELECT DISTINCT id, author FROM ap) USING (id) WHERE topic = 2 GROUP BY ALL")
def topic_network(spark, d):
    return graph.ranking(themes.of_topic(with_topics(spark, d), 2), "authors").select(F.lit(2).alias("topic"), "item", "n")


@query(""" SELECT CASE len(countries) WHEN 0 THEN 'Unknown' WHEN 1 THEN 'SCP' ELSE 'MCP' END AS class, count(*) AS n, round_even(100.0 * count(*) / (SELECT count(*) FROM art), 1) AS pct FROM art GROUP BY 1
  UNION ALL SELECT x, 0, 0.0 FROM (SELECT unnest(['SCP', 'MCP', 'Unknown']) AS x) WHERE x NOT IN (SELECT CASE len(countries) WHEN 0 THEN 'Unknown' WHEN 1 THEN 'SCP' ELSE 'MCP' END FROM art)""")
def country_classification(spark, d):
    return geo.classification(articles(spark, d, mncs=False)).withColumn("pct", F.col("pct").cast("double"))


_CTRY = """, cr AS (SELECT id, year, cites, mncs, len(countries) AS k, unnest(countries) AS country FROM art), ct AS (SELECT country, count(*) AS articles, count(*) FILTER (k = 1) AS scp,
  count(*) FILTER (k > 1) AS mcp, avg(mncs) AS mean_mncs, CAST(coalesce(sum(cites), 0) AS BIGINT) AS cites FROM cr GROUP BY country)"""


@query(_CTRY + """ SELECT country, articles, scp, mcp, round(mean_mncs, 6) AS mean_mncs, cites, round_even(100.0 * scp / articles, 1) AS scp_pct,
  round_even(100.0 * mcp / articles, 1) AS mcp_pct, round(mcp / articles, 6) AS mcp_ratio FROM ct""")
def country_collab(spark, d):
    out = geo.country_table(articles(spark, d))
    return rounded(out, "mean_mncs", "mcp_ratio").withColumns({c: F.col(c).cast("double") for c in ("scp_pct", "mcp_pct")})


@query(_CTRY + " SELECT country, articles, round(mean_mncs, 6) AS mean_mncs, cites FROM ct WHERE articles >= 5 AND mean_mncs IS NOT NULL ORDER BY ct.mean_mncs DESC, country LIMIT 10")
def country_impact(spark, d):
    return rounded(geo.impact(geo.country_table(articles(spark, d)), 5, 10).select("country", "articles", "mean_mncs", "cites"), "mean_mncs")


@query(_CTRY + """, k AS (SELECT * FROM ct WHERE articles >= 5 AND mean_mncs IS NOT NULL) SELECT country, articles, (SELECT quantile_cont(articles, 0.5) FROM k) AS median_articles,
  (SELECT round(quantile_cont(cites, 0.02), 6) FROM k) AS low, (SELECT round(quantile_cont(cites, 0.98), 6) FROM k) AS high FROM k""")
def country_matrix(spark, d):
    out = geo.matrix(geo.country_table(articles(spark, d)), 5)
    return out.select("country", "articles", "median_articles", F.round(F.col("bounds")[0], 6).alias("low"), F.round(F.col("bounds")[1], 6).alias("high"))


@query(_CTRY + """, q AS (SELECT quantile_cont(articles, 0.25) AS a, quantile_cont(articles, 0.5) AS b, quantile_cont(articles, 0.75) AS c FROM ct)
  SELECT country, articles, CASE WHEN articles < a THEN 'Low' WHEN articles < b THEN 'Medium' WHEN articles < c THEN 'High' ELSE 'Very High' END AS tier FROM ct, q""")
def country_tiers(spark, d):
    return geo.tiers(geo.country_table(articles(spark, d)))


_GRID = """, cr AS (SELECT year, unnest(countries) AS country FROM art WHERE year IS NOT NULL), c AS (SELECT year, country, count(*) AS n FROM cr GROUP BY ALL),
  g AS (SELECT y.year, x.country, coalesce(n, 0) AS n FROM (SELECT DISTINCT country FROM c) x CROSS JOIN (SELECT CAST(unnest(generate_series(min(year), max(year))) AS INTEGER) AS year FROM c) y
  LEFT JOIN c ON c.year = y.year AND c.country = x.country), gr AS (SELECT year, country, n, row_number() OVER (PARTITION BY year ORDER BY n DESC, country) AS rank FROM g)"""


@query(_GRID + " SELECT year, country, n, rank FROM gr")
def country_rank_grid(spark, d):
    return geo.year_grid(articles(spark, d, mncs=False)).withColumn("rank", F.col("rank").cast("bigint"))


@query(_GRID + " SELECT year, country, n, rank FROM gr WHERE country = 'Germany' ORDER BY n DESC, year LIMIT 1")
def country_peak(spark, d):
    return geo.case_study(articles(spark, d), "Germany")["peak"].withColumn("rank", F.col("rank").cast("bigint"))


@query(""", o AS (SELECT id, countries FROM art WHERE list_contains(countries, 'Germany')) SELECT item, count(*) AS n FROM (SELECT unnest(countries) AS item FROM o) WHERE item <> 'Germany'
  GROUP BY item ORDER BY n DESC, item LIMIT 10""")
def country_partners(spark, d):
    return geo.case_study(articles(spark, d), "Germany")["partners"]


@query(" SELECT keywords AS item, count(*) AS n FROM art WHERE keywords IS NOT NULL GROUP BY 1 ORDER BY n DESC, item LIMIT 10")
def frequency(spark, d):
    return metrics.frequency(articles(spark, d, False, False), "keywords", 10)


_CPAIRS, _IPAIRS = PAIRS.format(c="country"), PAIRS.format(c="author")


@query(_CPAIRS + " SELECT src, dst, weight FROM e")
def country_pairs(spark, d):
    return graph.pair_edges(articles(spark, d, mncs=False), "countries")


@query(_CPAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS r FROM m)
  SELECT DISTINCT least(node, other) AS src, greatest(node, other) AS dst, weight FROM r WHERE r <= 3""")
def country_topk_edges(spark, d):
    return graph.top_ties(graph.pair_edges(articles(spark, d, mncs=False), "countries"), 3)


@query(_CPAIRS + " SELECT src, dst, weight, 2 * weight > (SELECT max(weight) FROM e) AS strong FROM e")
def strong_ties(spark, d):
    return graph.strong_ties(graph.pair_edges(articles(spark, d, mncs=False), "countries"))


@query(" SELECT author AS item, count(DISTINCT id) AS n FROM ap JOIN orders ON id = o_orderkey GROUP BY 1")
def inst_ranking(spark, d):
    return graph.ranking(articles(spark, d, mncs=False), "authors")


_EU = "list_bool_and(list_transform(countries, lambda x: x IN ('" + "', '".join(NATIONS[:15]) + "')))"


@query(f""", f AS (SELECT id, len(countries) AS k, len(countries) > 0 AND coalesce({_EU}, false) AS eu FROM art) SELECT scope, n FROM (
  SELECT 'Global_All' AS scope, count(*) AS n FROM f UNION ALL SELECT 'Global_MCP', count(*) FROM f WHERE k > 1 UNION ALL SELECT 'Global_SCP', count(*) FROM f WHERE k = 1
  UNION ALL SELECT 'EU_All', count(*) FROM f WHERE eu UNION ALL SELECT 'EU_MCP', count(*) FROM f WHERE eu AND k > 1 UNION ALL SELECT 'EU_SCP', count(*) FROM f WHERE eu AND k = 1)""")
def inst_scope_filter(spark, d):
    from scholar_spark.schema import SCOPES

    rows = articles(spark, d, mncs=False)
    out = None
    for s in SCOPES:
        n = entities.in_scope(rows, s).agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(""", ok AS (SELECT id FROM art WHERE len(authors) BETWEEN 2 AND 5) SELECT x.author AS src, y.author AS dst, count(*) AS weight FROM ap x JOIN ap y ON x.id = y.id AND x.author < y.author
  WHERE x.id IN (SELECT id FROM ok) GROUP BY ALL""")
def inst_pairs_capped(spark, d):
    return graph.pair_edges(articles(spark, d, mncs=False), "authors", 5)


@query(" SELECT count(*) FILTER (len(authors) > 5) AS n_excluded, count(*) FILTER (len(authors) BETWEEN 2 AND 5) AS n_eligible FROM art")
def inst_edge_audit(spark, d):
    return graph.edge_audit(articles(spark, d, mncs=False), "authors", 5)


@query(_IPAIRS + " SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength, round(count(*) / ((SELECT count(DISTINCT node) FROM m) - 1), 6) AS centrality FROM m GROUP BY node")
def node_degree(spark, d):
    authors = network(spark, d)
    return rounded(authors.named(graph.node_degrees(authors.edges), "node"), "centrality")


@query(_IPAIRS + """, t AS (SELECT author AS node FROM ap JOIN orders ON id = o_orderkey GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
  SELECT src, dst, weight FROM e WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)""")
def induced_subgraph(spark, d):
    rows = articles(spark, d, mncs=False)
    top = graph.ranking(rows, "authors").orderBy(F.desc("n"), "item").limit(20).select(F.col("item").alias("node"))
    return graph.induced(graph.pair_edges(rows, "authors"), top)


@query(_CPAIRS + " SELECT (SELECT count(DISTINCT node) FROM m) AS nodes, count(*) AS edges, round(2.0 * count(*) / ((SELECT count(DISTINCT node) FROM m) * ((SELECT count(DISTINCT node) FROM m) - 1)), 6) AS density FROM e")
def network_density(spark, d):
    return rounded(graph.density(graph.pair_edges(articles(spark, d, mncs=False), "countries")), "density")


@query()
def betweenness(spark, d):
    return rounded(graph.betweenness(graph.pair_edges(articles(spark, d, mncs=False), "countries")), "betweenness")


@query()
def louvain(spark, d):
    return graph.communities(graph.pair_edges(articles(spark, d, mncs=False), "countries"))


def network(spark, d):
    """The author network, between numbers."""
    return graph.Coded(appearances(spark, d).select("id", F.col("author").alias("item")))


@query()
def author_communities(spark, d):
    authors = network(spark, d)
    found = communities.partitions(authors.graph())
    value = F.broadcast(communities.modularity(authors.graph(), found))  # one row
    return authors.named(communities.ranked(found).join(value, "g").select("node", "community", F.round("modularity", 6).alias("modularity")), "node")


#: The strongest ties of each author: a thin network of several components.
_THIN = _IPAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS r FROM m),
  thin AS (SELECT node AS src, other AS dst FROM r WHERE r <= {k} UNION SELECT other, node FROM r WHERE r <= {k})"""


def thin_network(authors, k):
    return authors.top_ties(k).withColumn("g", F.lit(0).cast("long"))


@query(_THIN.replace("{k}", "1") + """, walk AS (SELECT src AS node, src AS reach FROM thin UNION SELECT walk.node, dst FROM walk JOIN thin ON reach = src),
  c AS (SELECT node, min(reach) AS component FROM walk GROUP BY node), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1)
  SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS rank FROM s""", recursive=True)
def network_components(spark, d):
    authors = network(spark, d)
    return authors.named(communities.component_sizes(communities.components(thin_network(authors, 1))).drop("g"), "component")


@query(_IPAIRS + """, far(node, reach, step) USING KEY (node, reach) AS (SELECT DISTINCT node, node, 0 FROM m UNION SELECT far.node, m.other, min(far.step + 1) FROM far JOIN m ON far.reach = m.node
  LEFT JOIN recurring.far AS r ON r.node = far.node AND r.reach = m.other WHERE r.node IS NULL GROUP BY far.node, m.other)
  SELECT node, round(CASE WHEN sum(step) > 0 THEN (count(*) - 1) / sum(step) * (count(*) - 1) / ((SELECT count(DISTINCT node) FROM m) - 1) ELSE 0 END, 6) AS closeness
  FROM far GROUP BY node""", recursive=True)
def network_closeness(spark, d):
    authors = network(spark, d)
    return rounded(authors.named(centrality.exact_closeness(authors.graph()).drop("g"), "node"), "closeness")


@query()
def network_eigenvector(spark, d):
    authors = network(spark, d)
    return rounded(authors.named(centrality.eigenvector(authors.graph()).drop("g"), "node"), "eigenvector")


@query(_IPAIRS + " SELECT g, node, count(*) AS degree FROM m, (SELECT unnest(range(3)) AS g) GROUP BY ALL")
def null_degrees(spark, d):
    authors = network(spark, d)
    ends = validation.stubs(authors.edges, 3).select("g", F.explode(F.array("src", "dst")).alias("node"))
    return authors.named(ends.groupBy("g", "node").agg(F.count("*").alias("degree")), "node")


@query(_IPAIRS + """, f AS (SELECT src, dst, CAST('0x' || substr(md5(src || '|' || dst || '|42'), 1, 8) AS BIGINT) % 5 AS fold FROM e), k AS (SELECT unnest(range(5)) AS f),
  x AS (SELECT f, node, count(*) AS n FROM (SELECT f, src AS node FROM f, k WHERE fold <> f UNION ALL SELECT f, dst FROM f, k WHERE fold <> f) GROUP BY ALL),
  t AS (SELECT f, count(*) AS nodes FROM x GROUP BY f), v AS (SELECT f, node, coalesce(n, 0) / (nodes - 1) AS d FROM (SELECT f, nodes, node FROM k JOIN t USING (f) CROSS JOIN (SELECT DISTINCT node FROM m)) LEFT JOIN x USING (f, node)),
  r AS (SELECT a.f AS i, b.f AS j, corr(a.d, b.d) AS r FROM v a JOIN v b ON a.node = b.node AND a.f < b.f GROUP BY ALL) SELECT 'degree' AS measure, round(avg(r), 6) AS correlation, count(r) AS pairs FROM r""")
def fold_degree_correlation(spark, d):
    authors = network(spark, d)
    ends = authors.named(authors.graph().withColumns({"a": F.col("src"), "b": F.col("dst")}), "a", "b")
    folds = centrality.degree(validation.fold_graphs(ends, ends=("a", "b")))
    nodes = graph.mirrored(authors.edges).select("node").distinct().withColumn("g", F.explode(F.expr("sequence(0L, 4L)")))
    values = nodes.join(folds, ["g", "node"], "left").select(F.col("g").cast("int").alias("f"), "node", F.coalesce("degree", F.lit(0.0)).alias("degree"))
    return rounded(validation.fold_correlations(values, ("degree",)), "correlation")


#: Labels that the digits of a name give for each of five folds.
_FOLDS = """, p AS (SELECT DISTINCT country AS node FROM ap), f AS (SELECT unnest(range(5)) AS f), l AS (SELECT node, f, 'c' || ((ascii(node) + length(node) * f) % 3) AS community FROM p, f)"""


@query(_FOLDS + """, j AS (SELECT a.f AS i, b.f AS j, a.community AS x, b.community AS y, count(*) / (SELECT count(*) FROM p) AS p FROM l a JOIN l b ON a.node = b.node AND a.f < b.f GROUP BY ALL),
  px AS (SELECT i, j, x, sum(p) AS px FROM j GROUP BY ALL), py AS (SELECT i, j, y, sum(p) AS py FROM j GROUP BY ALL), hx AS (SELECT i, j, -sum(px * ln(px)) AS hx FROM px GROUP BY ALL), hy AS (SELECT i, j, -sum(py * ln(py)) AS hy FROM py GROUP BY ALL)
  SELECT i, j, round(greatest(0, sum(p * ln(p / (px * py))) / ((any_value(hx) + any_value(hy)) / 2)), 6) AS nmi FROM j JOIN px USING (i, j, x) JOIN py USING (i, j, y) JOIN hx USING (i, j) JOIN hy USING (i, j) GROUP BY ALL""")
def fold_agreement(spark, d):
    nodes = appearances(spark, d).select(F.col("country").alias("node")).distinct().withColumn("g", F.explode(F.expr("sequence(0L, 4L)")))
    labels = nodes.withColumn("community", F.concat(F.lit("c"), (F.ascii("node") + F.length("node") * F.col("g")) % 3))
    return rounded(validation.fold_agreement(labels), "nmi").drop("g")


@query()
def community_validation(spark, d):
    edges = graph.pair_edges(articles(spark, d, mncs=False), "countries")
    report = validation.validate_communities(edges)["report"]
    return rounded(report, *[n for n, kind in report.dtypes if kind == "double"])


@query(""", p AS (SELECT DISTINCT country AS node, length(country) % 3 AS x, ascii(country) % 2 AS y FROM ap), j AS (SELECT x, y, count(*) / (SELECT count(*) FROM p) AS p FROM p GROUP BY ALL),
  px AS (SELECT x, sum(p) AS px FROM j GROUP BY x), py AS (SELECT y, sum(p) AS py FROM j GROUP BY y) SELECT round((SELECT sum(p * ln(p / (px * py))) FROM j JOIN px USING (x) JOIN py USING (y))
  / ((-(SELECT sum(px * ln(px)) FROM px) - (SELECT sum(py * ln(py)) FROM py)) / 2), 6) AS nmi""")
def partition_nmi(spark, d):
    nodes = appearances(spark, d).select(F.col("country").alias("node")).distinct()
    a = nodes.select("node", F.length("node") % 3)
    return rounded(graph.normalized_mutual_information(a, nodes.select("node", F.ascii("node") % 2)), "nmi")


_DOI = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN ' https://doi.org/10.1/AB' || o_custkey || '. ' WHEN 1 THEN 'doi: 10.1/ab ' || o_custkey WHEN 2 THEN 'N/A' WHEN 3 THEN NULL ELSE '10.1/Ab' || o_custkey || ';' END AS raw FROM orders"


def _dois(spark, d):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" https://doi.org/10.1/AB"), c, F.lit(". "))).when(k == 1, F.concat(F.lit("doi: 10.1/ab "), c)).when(k == 2, "N/A").when(k == 4, F.concat(F.lit("10.1/Ab"), c, F.lit(";")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", "o_totalprice", raw.alias("raw"))


@query(f"SELECT id, CASE WHEN raw IS NULL OR raw = 'N/A' THEN NULL ELSE rtrim(lower(replace(regexp_replace(trim(raw), '^(doi: |https://doi.org/)', ''), ' ', '')), '.,;') END AS doi FROM ({_DOI})", base=False)
def doi_normalize(spark, d):
    return _dois(spark, d).select("id", X.doi(F.col("raw")).alias("doi"))


@query("SELECT doc_id, md5(nullif(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), '')) AS key FROM documents", base=False)
def title_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.title_key(F.col("text")).cast("binary")).alias("key"))


@query("SELECT s_suppkey AS id, [trim(s_name), 'Key ' || s_nationkey] AS authors FROM supplier", base=False)
def author_split(spark, d):
    joined = F.concat(F.lit(" "), F.col("s_name"), F.lit(" ;; Key "), F.col("s_nationkey").cast("string"), F.lit("; "))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), X.pieces(joined).alias("authors"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN 2 END AS refs FROM supplier", base=False)
def reference_count(spark, d):
    k = F.col("s_suppkey") % 4
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), X.reference_count(F.when(k == 0, "  ").when(k == 1, "NaN").when(k == 2, "Ref A; ;Ref B")).alias("refs"))


@query("SELECT p_partkey AS id, lower(replace(p_name, ' ', ' ')) || ' and co' AS key FROM part", base=False)
def source_key(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.source_key(F.concat("p_name", F.lit(" & Co."))).alias("key"))


@query()
def journal_title(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.journal_title(F.concat(F.lit("the journal of IEEE "), "p_name")).alias("title"))


def _records(spark, d):
    """Orders as records: two databases, few DOIs, titles by customer."""
    o = _dois(spark, d)
    key = F.col("id")
    return o.select(
        key.alias("row_id"),
        F.col("raw").alias("DOI"),
        F.when(key % 7 != 0, F.concat(F.lit("Work "), (F.col("o_custkey") % 50).cast("string"))).alias("Title"),
        F.when(key % 11 != 0, F.year("o_orderdate").cast("double")).alias("Publication Year"),
        F.when(key % 3 != 0, F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("Cited by"),
        F.when(key % 2 == 0, "Scopus").otherwise("Web of Science").alias("Primary Database"),
        F.array(F.when(key % 2 == 0, "Scopus").otherwise("Web of Science")).alias("Databases"),
        F.array(F.concat(F.lit("file_"), (key % 4).cast("string"))).alias("Source Files"),
        F.when(key % 5 != 1, F.concat(F.lit("abs "), key.cast("string"))).alias("Abstract"),
    )


_REC = f"""WITH r AS (SELECT q.id, CASE WHEN raw IS NULL OR raw = 'N/A' THEN NULL ELSE rtrim(lower(replace(regexp_replace(trim(raw), '^(doi: |https://doi.org/)', ''), ' ', '')), '.,;') END AS doi, raw,
  CASE WHEN q.id % 7 <> 0 THEN 'work' || (o_custkey % 50) END AS t, CASE WHEN q.id % 11 <> 0 THEN year(o_orderdate) END AS y, CASE WHEN q.id % 3 <> 0 THEN floor(o_totalprice / 1000) END AS c,
  CASE WHEN q.id % 2 = 0 THEN 'Scopus' ELSE 'Web of Science' END AS db, 'file_' || (q.id % 4) AS f, CASE WHEN q.id % 5 <> 1 THEN 'abs ' || q.id END AS ab FROM ({_DOI}) q JOIN orders ON o_orderkey = q.id),
k AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN t IS NOT NULL AND y IS NOT NULL THEN 'title-year:' || t || '|' || y ELSE 'unmatched-row:' || id END AS key FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(c, -1) DESC, id) AS pr FROM k)"""


@query(_REC + """ SELECT key, count(*) AS group_size, arg_min(id, pr) AS row_id, arg_min(ab, pr) FILTER (ab IS NOT NULL) AS abstract, arg_min(c, pr) FILTER (c IS NOT NULL) AS cites,
  arg_min(db, pr) AS primary_db FROM p GROUP BY key""", base=False)
def link_key_fuse(spark, d):
    out = linkage.fuse(_records(spark, d))
    return out.select("key", "group_size", "row_id", F.col("Abstract").alias("abstract"), F.col("`Cited by`").alias("cites"), F.col("`Primary Database`").alias("primary_db"))


@query(_REC + """, f AS (SELECT key, f, min(id) AS place FROM k GROUP BY ALL) SELECT key, (SELECT string_agg(db, '; ' ORDER BY db) FROM (SELECT DISTINCT db FROM k x WHERE x.key = f.key)) AS databases,
  string_agg(f, '; ' ORDER BY place) AS files FROM f GROUP BY key""", base=False)
def provenance_union(spark, d):
    out = linkage.fuse(_records(spark, d))
    return out.select("key", F.array_join("Databases", "; ").alias("databases"), F.array_join("`Source Files`", "; ").alias("files"))


@query(_REC + """, g AS (SELECT key, count(*) AS s FROM k GROUP BY key) SELECT (SELECT count(*) FROM k) AS n_merged, (SELECT count(*) FROM k WHERE key LIKE 'doi:%') AS n_with_doi,
  CAST(coalesce(sum(s - 1) FILTER (key LIKE 'doi:%'), 0) AS BIGINT) AS n_removed_doi, CAST(coalesce(sum(s - 1) FILTER (key LIKE 'title-year:%'), 0) AS BIGINT) AS n_removed_title_year,
  count(*) FILTER (s > 1) AS n_fused_groups, count(*) AS n_final FROM g""", base=False)
def prisma_counts(spark, d):
    r = linkage.with_keys(_records(spark, d))
    return linkage.prisma(r, linkage.fuse(r)).select("n_merged", "n_with_doi", "n_removed_doi", "n_removed_title_year", "n_fused_groups", "n_final")


@query(" SELECT count(*) AS n, min(year) AS lo, max(year) AS hi FROM art WHERE year < 2000")
def time_filter(spark, d):
    return linkage.time_filter(articles(spark, d, False, False), 2000, "year").agg(F.count("*").alias("n"), F.min("year").alias("lo"), F.max("year").alias("hi"))


_GRAMS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_\-]*[\p{L}\p{N}_]') AS w FROM documents),
i AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS n)),
g AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS ngram FROM i),
c AS (SELECT ngram, CAST(n AS INTEGER) AS n, count(*) AS total, count(DISTINCT doc_id) AS df FROM g GROUP BY ALL),
d AS (SELECT count(*) AS m FROM documents), q AS (SELECT c.* FROM c, d WHERE df >= greatest(1, least(greatest(5, m // 100), m)) AND df <= 0.9 * m)"""


@query(_GRAMS + " SELECT ngram, n, total, df FROM q", base=False)
def ngram_counts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return themes.counted_ngrams(docs)


@query(_GRAMS + """ SELECT ngram, n, total, df FROM (SELECT *, string_split(ngram, ' ') AS p FROM q) WHERE len(list_distinct(p)) = n
  AND (n = 1 OR p[n] <> array_to_string(list_transform(p[1:n - 1], lambda x: left(x, 1)), ''))""", base=False)
def ngram_filters(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return themes.frequent_ngrams(docs)


_CV = r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), l AS (SELECT id, w, greatest(len(w) - 110, 0) AS last FROM w),
p AS (SELECT id, last, unnest(w) AS term, unnest(range(len(w))) AS place FROM l), f AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS k FROM p GROUP BY term),
t AS (SELECT CAST(k % 3 AS BIGINT) AS topic, term FROM f WHERE k BETWEEN 20 AND 34), c AS (SELECT DISTINCT topic, term, id, unnest(range(greatest(place - 109, 0), least(place, last) + 1)) AS s FROM p JOIN t USING (term)),
n AS (SELECT sum(last + 1) AS m FROM l), b AS (SELECT x.topic, x.term AS x, y.term AS y, count(*) AS cnt FROM c x JOIN c y ON x.topic = y.topic AND x.id = y.id AND x.s = y.s GROUP BY ALL),
e AS (SELECT x.topic, x.term AS x, y.term AS y, coalesce(cnt, 0) AS cnt FROM t x JOIN t y USING (topic) LEFT JOIN b ON b.topic = x.topic AND b.x = x.term AND b.y = y.term),
o AS (SELECT topic, x AS term, cnt AS n FROM e WHERE x = y), v AS (SELECT e.topic, e.x, e.y, ln((cnt / m + 1e-12) / (ox.n / m * oy.n / m)) / -ln(cnt / m + 1e-12) AS v FROM e JOIN o ox ON ox.topic = e.topic AND ox.term = e.x
JOIN o oy ON oy.topic = e.topic AND oy.term = e.y, n), z AS (SELECT topic, y, sum(v) AS s FROM v GROUP BY ALL), q AS (SELECT topic, sqrt(sum(s * s)) AS q FROM z GROUP BY topic),
r AS (SELECT v.topic, x, sum(v * s) / (sqrt(sum(v * v)) * any_value(q)) AS r FROM v JOIN z ON z.topic = v.topic AND z.y = v.y JOIN q ON q.topic = v.topic GROUP BY ALL) SELECT topic, round(avg(r), 6) AS coherence FROM r GROUP BY topic"""


@query(_CV, base=False)
def cv_coherence(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("tokens"))
    counts = docs.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "term").limit(35)
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "term"))).alias("a")).select(F.posexplode("a").alias("k", "x"))
    terms = listed.where("k BETWEEN 20 AND 34").select((F.col("k") % 3).cast("long").alias("topic"), F.col("x.term").alias("term"))
    return rounded(themes.cv_coherence(terms, docs), "coherence")


@query()
def processed_text(spark, d):
    out = table(spark, d, "documents").select("doc_id", themes.processed(F.col("text"), themes.noise_terms()).alias("processed"))
    return out.select("doc_id", F.length("processed").alias("n_chars"), F.md5(F.col("processed").cast("binary")).alias("digest"))


_DT = ", dt AS (SELECT DISTINCT id, author AS term FROM ap), tt AS (SELECT term, (ascii(right(term, 1)) % 3) AS topic FROM (SELECT DISTINCT term FROM dt)), rk AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY term) AS rank FROM tt)"


@query(_DT + """, pr AS (SELECT x.topic, x.term AS x, y.term AS y FROM rk x JOIN rk y ON x.topic = y.topic AND x.rank > y.rank),
  b AS (SELECT p.x AS bx, p.y AS by_, count(*) AS n FROM (SELECT DISTINCT x, y FROM pr) p JOIN dt a ON a.term = p.x JOIN dt c ON c.term = p.y AND c.id = a.id GROUP BY ALL),
  s AS (SELECT term, count(*) AS n FROM dt GROUP BY term) SELECT round(avg(ln((coalesce(b.n, 0) + 1) / greatest(1, coalesce(s.n, 0)))), 6) AS coherence FROM pr LEFT JOIN b ON bx = x AND by_ = y LEFT JOIN s ON s.term = y""")
def umass_coherence(spark, d):
    terms = appearances(spark, d).select("id", F.col("author").alias("term")).distinct()
    topics = terms.select("term").distinct().withColumn("topic", F.ascii(F.substring("term", -1, 1)) % 3)
    ranked = lineage.numbered(topics, [F.col("term")], ("topic",), "rank").select("topic", "rank", "term")
    return rounded(themes.umass_coherence(ranked, terms), "coherence")


@query(" SELECT id, CASE WHEN year IS NULL THEN NULL ELSE (year // 3 * 3) || '-' || (year // 3 * 3 + 2) END AS slice FROM art")
def topic_time_slice(spark, d):
    return articles(spark, d, False, False).select("id", themes.time_slice(F.col("year"), 3).alias("slice"))


_SLICES = ", sl AS (SELECT CAST(unnest(generate_series(min(year // 3 * 3), max(year // 3 * 3), 3)) AS INTEGER) AS lo FROM mix WHERE year IS NOT NULL), sx AS (SELECT lo, lo || '-' || (lo + 2) AS slice FROM sl)"


@query(TOPICS + _SLICES + """, p AS (SELECT year // 3 * 3 AS lo, CAST(t AS INTEGER) AS topic, avg(topic_mix[t]) AS share FROM mix, (SELECT unnest([1, 2, 3, 4]) AS t) WHERE year IS NOT NULL GROUP BY ALL)
  SELECT slice, CAST(t AS INTEGER) AS topic, round(coalesce(share, 0), 6) AS share FROM sx CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS t) LEFT JOIN p ON p.lo = sx.lo AND p.topic = t""")
def topic_evolution(spark, d):
    return rounded(themes.topic_evolution(with_topics(spark, d), 3, 4), "share")


@query(TOPICS + _SLICES + """ SELECT slice, count(*) FILTER (topic = 1) AS "1", count(*) FILTER (topic = 2) AS "2", count(*) FILTER (topic = 3) AS "3", count(*) FILTER (topic = 4) AS "4"
  FROM sx LEFT JOIN mix ON year // 3 * 3 = lo GROUP BY slice""")
def topic_counts(spark, d):
    return themes.topic_counts(with_topics(spark, d), 3, 4)


@query(TOPICS + " SELECT topic, round(avg(mncs), 6) AS mean_mncs, count(*) AS n FROM mix GROUP BY topic")
def topic_impact(spark, d):
    return rounded(themes.topic_impact(with_topics(spark, d)), "mean_mncs")


@query(TOPICS + ", r2 AS (SELECT topic, id, cites, row_number() OVER (PARTITION BY topic ORDER BY cites DESC NULLS LAST, id) AS k FROM mix) SELECT topic, id, cites FROM r2 WHERE k = 1")
def topic_first_article(spark, d):
    return themes.top_articles(with_topics(spark, d)).select("topic", "id", "cites")


@query(TOPICS + """, c AS (SELECT unnest(countries) AS country, topic FROM mix), n AS (SELECT country, topic, count(*) AS n FROM c GROUP BY ALL), a AS (SELECT country, sum(n) AS nc FROM n GROUP BY country),
  b AS (SELECT topic, sum(n) AS nt FROM n GROUP BY topic) SELECT country, topic, round(n * (SELECT sum(n) FROM n) / (nc * nt), 6) AS index FROM n JOIN a USING (country) JOIN b USING (topic) WHERE nc >= 10""")
def activity_index(spark, d):
    return rounded(themes.activity_index(with_topics(spark, d), 10), "index")


@query(TOPICS + """ SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, count(*) FILTER (a <> b AND topic_mix[a] > 0.2 AND topic_mix[b] > 0.2) AS n FROM mix, (SELECT unnest([1, 2, 3, 4]) AS a), (SELECT unnest([1, 2, 3, 4]) AS b) GROUP BY ALL""")
def cooccurrence(spark, d):
    return themes.topic_cooccurrence(with_topics(spark, d), 4, 0.2)


@query("SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events", base=False)
def json_handoff(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k"))


@query()
def institution_standardize(spark, d):
    raw = table(spark, d, "supplier").select(F.concat(F.lit("Dept Phys, "), "s_name", F.lit(" Univ Sci, Springfield 12345, USA")).alias("Affiliations"), F.col("s_suppkey").alias("row_id"))
    return entities.resolve(raw)[0].select("row_id", F.array_join("institutions", "; ").alias("institutions"), F.array_join("countries", "; ").alias("countries"))


@query()
def lda_topics(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), themes.processed(F.col("text"), themes.noise_terms()).alias("processed"))
    rows, words = themes.document_terms(docs)
    return themes.describe_topics(themes.fit_lda(rows, 3), words)


@query()
def nmf_topics(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), themes.processed(F.col("text"), themes.noise_terms()).alias("processed"))
    _, h, _ = themes.fit_nmf(themes.term_weights(themes.document_terms(docs)[0]), 3)
    return h.select("term", (F.array_position("h", F.array_max("h"))).cast("int").alias("topic"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
