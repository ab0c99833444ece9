"""Record linkage: duplicate keys, priority, field-wise fusion, provenance and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholar_spark import schema as S
from scholar_spark.functions import text as X

#: Columns that fusion treats by rules of their own.
OWN_RULES = ("Primary Database", "Databases", "Source Files")


def duplicate_key(row_id: Column, doi: Column, title: Column, year: Column) -> Column:
    """doi:..., else title-year:...|..., else a key of the row alone."""
    by_doi, by_title, by_year = X.doi(doi), X.title_key(title), X.year_key(year)
    return (
        F.when(by_doi.isNotNull(), F.concat(F.lit("doi:"), by_doi))
        .when(by_title.isNotNull() & by_year.isNotNull(), F.concat(F.lit("title-year:"), by_title, F.lit("|"), by_year))
        .otherwise(F.concat(F.lit("unmatched-row:"), row_id.cast("string")))
    )


def _filled(name: str, kind: str) -> Column:
    """The value where fusion counts it as present, else null."""
    c = F.col(f"`{name}`")
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, c)
    if name == "Cited References Raw" or kind != "string":
        return c
    return X.present(c)


def distinct_files(files: Column) -> Column:
    """Ordered distinct file names, case aside, in their first spelling."""
    def add(done, x):
        return F.when(F.exists(done, lambda y: F.lower(y) == F.lower(x)), done).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(files, F.array().cast("array<string>"), add)


def known_databases(names: Column) -> Column:
    """The databases named, in fixed order."""
    said = F.transform(names, lambda x: F.when(F.lower(x) == "wos", "Web of Science").when(F.lower(x) == "scopus", "Scopus").otherwise(x))
    fixed = F.array(*[F.lit(d) for d in S.DATABASES])
    return F.concat(F.filter(fixed, lambda d: F.array_contains(said, d)), F.array_except(F.array_sort(F.array_distinct(said)), fixed))


def with_keys(articles: DataFrame) -> DataFrame:
    """Adds ``key`` from row_id, DOI, Title and Publication Year."""
    return articles.withColumn("key", duplicate_key(F.col("row_id"), F.col("DOI"), F.col("Title"), F.col("Publication Year")))


def fuse(articles: DataFrame) -> DataFrame:
    """One row for each duplicate key.

    The primary row has the most citations (null least), ties by row_id. Each field is the primary's, else
    the first present one in that order; 'Primary Database' is always the primary's; 'Databases' is the
    union in fixed order, 'Source Files' the union in row order. Adds key, group_size, fused_rank (citations
    descending, row ascending: order by it at the sink) and n_filled.

    One shuffle by key: an aggregate of minima with map-side combine, no window over the rows.
    """
    kinds = dict(articles.dtypes)
    order = F.struct((-F.coalesce(F.col("`Cited by`"), F.lit(float("-inf")))).alias("c"), F.col("row_id").alias("r"))
    names = [c for c in articles.columns if c not in ("row_id", "key", *OWN_RULES)]
    keyed = (articles if "key" in articles.columns else with_keys(articles)).withColumn("_order", order)
    filled = {c: _filled(c, kinds[c]) for c in names}
    primary = [x for i, c in enumerate(names) for x in (F.col(f"`{c}`").alias(f"p{i}"), filled[c].isNull().alias(f"gap{i}"))]
    if "Primary Database" in kinds:
        primary.append(F.col("`Primary Database`").alias("db"))
    picks = [F.min(F.struct("_order", *primary)).alias("_p")]
    picks += [F.min(F.when(filled[c].isNotNull(), F.struct("_order", filled[c].alias("v")))).alias(f"v{i}") for i, c in enumerate(names)]
    for c in ("Databases", "Source Files"):
        if c in kinds:
            picks.append(F.array_sort(F.collect_list(F.struct("row_id", F.col(f"`{c}`").alias("v")))).alias(f"_{c[0]}"))
    one = keyed.groupBy("key").agg(F.count("*").alias("group_size"), *picks)
    out = [F.col("_p._order.r").alias("row_id"), F.col("key"), F.col("group_size")]
    for i, c in enumerate(names):
        out.append(F.coalesce(F.col(f"v{i}.v"), F.col(f"_p.p{i}")).alias(c))
    gaps = [F.when(F.col(f"_p.gap{i}") & F.col(f"v{i}").isNotNull(), 1).otherwise(0) for i in range(len(names))]
    flat = lambda c: F.flatten(F.transform(F.col(c), lambda s: F.coalesce(s["v"], F.array().cast("array<string>"))))
    if "Primary Database" in kinds:
        out.append(F.col("_p.db").alias("Primary Database"))
    if "Databases" in kinds:
        out.append(known_databases(flat("_D")).alias("Databases"))
    if "Source Files" in kinds:
        out.append(distinct_files(flat("_S")).alias("Source Files"))
    out += [F.col("_p._order").alias("fused_rank"), reduce(Column.__add__, gaps, F.lit(0)).alias("n_filled")]
    out.append(F.array_compact(F.array(*[F.when(g == 1, F.lit(c)) for g, c in zip(gaps, names)])).alias("filled"))
    return one.select(*out)


def prisma(articles: DataFrame, fused: DataFrame) -> DataFrame:
    """One row of counters: records merged, removed by each rule, kept, and groups by kind."""
    keyed = articles if "key" in articles.columns else with_keys(articles)
    is_doi = F.col("key").startswith("doi:")
    before = keyed.agg(
        F.count("*").alias("n_merged"),
        F.count_if(is_doi).alias("n_with_doi"),
        F.count_if(~is_doi).alias("n_without_doi"),
        F.count_if(X.doi(F.col("DOI")).isNotNull() & ~F.col("DOI").eqNullSafe(X.doi(F.col("DOI")))).alias("n_doi_changed"),
        F.count_if(X.title_key(F.col("Title")).isNull()).alias("n_missing_title"),
        F.count_if(X.year_key(F.col("`Publication Year`")).isNull()).alias("n_missing_year"),
    )
    zero = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n)
    several = F.col("group_size") > 1
    after = fused.agg(
        zero(F.when(F.col("key").startswith("doi:"), F.col("group_size") - 1), "n_removed_doi"),
        zero(F.when(F.col("key").startswith("title-year:"), F.col("group_size") - 1), "n_removed_title_year"),
        F.count_if(several).alias("n_fused_groups"),
        F.count("*").alias("n_final"),
        zero(F.col("n_filled"), "n_cells_filled"),
        *([F.count_if(F.size("Databases") > 1).alias("n_multi_database")] if "Databases" in fused.columns else []),
        *([F.count_if(F.size("Source Files") > 1).alias("n_multi_file")] if "Source Files" in fused.columns else []),
    )
    return before.crossJoin(after)  # one row each


#: Rows of the flow table: stage, counter.
PRISMA_ROWS = (
    ("Records merged", "n_merged"), ("Records with a DOI", "n_with_doi"), ("Records without a DOI", "n_without_doi"),
    ("DOIs normalized", "n_doi_changed"), ("Records without a title", "n_missing_title"), ("Records without a year", "n_missing_year"),
    ("Duplicates removed by DOI", "n_removed_doi"), ("Duplicates removed by title and year", "n_removed_title_year"),
    ("Groups fused", "n_fused_groups"), ("Records after fusion", "n_final"),
)


def prisma_table(counts: DataFrame) -> DataFrame:
    """The one row of ``prisma`` as (position, stage, n)."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(stage).alias("stage"), F.col(c).cast("bigint").alias("n")) for i, (stage, c) in enumerate(PRISMA_ROWS, 1)])
    return counts.select(F.inline(rows))


def temporal_audit(before: DataFrame, after: DataFrame, cutoff: int | None, year: str = "year") -> DataFrame:
    """One row: whether the time filter ran, its cutoff, articles before and after, and the years that are left."""
    left = after.agg(F.count("*").alias("n_after"), F.min(year).cast("int").alias("first_year"), F.max(year).cast("int").alias("last_year"))
    head = before.agg(F.count("*").alias("n_before")).select(F.lit(cutoff is not None).alias("applied"), F.lit(cutoff).cast("int").alias("cutoff"), "n_before")
    return head.crossJoin(left)  # one row each


def prisma_text(counts: dict) -> str:
    """The flow as text, with the balance merged - removed = final."""
    removed = counts["n_removed_doi"] + counts["n_removed_title_year"]
    lines = [
        f"Records merged: {counts['n_merged']:,}",
        f"Duplicates removed by DOI: {counts['n_removed_doi']:,}",
        f"Duplicates removed by title and year: {counts['n_removed_title_year']:,}",
        f"Records after fusion: {counts['n_final']:,}",
        f"Balance: {'holds' if counts['n_merged'] - removed == counts['n_final'] else 'FAILS'}",
    ]
    return "\n".join(lines) + "\n"


def enrichment(fused: DataFrame) -> DataFrame:
    """Cells filled by fusion for each column."""
    return fused.select(F.explode("filled").alias("column")).groupBy("column").agg(F.count("*").alias("n_cells"))


def database_combinations(fused: DataFrame) -> DataFrame:
    return fused.groupBy(F.array_join("Databases", "; ").alias("databases")).agg(F.count("*").alias("n"))


def duplicates(articles: DataFrame) -> DataFrame:
    """All rows of duplicated DOI groups, for review."""
    keyed = articles if "key" in articles.columns else with_keys(articles)
    twice = keyed.where(F.col("key").startswith("doi:")).groupBy("key").count().where("count > 1").select("key")
    return keyed.join(twice, "key", "left_semi")


def time_filter(articles: DataFrame, cutoff: int, year: str = "Publication Year") -> DataFrame:
    """Rows before ``cutoff``; rows without a year go too, unless no row has one."""
    c = F.col(f"`{year}`")
    known = articles.select(c.alias("y")).where("y IS NOT NULL").limit(1)
    return articles.where(c < cutoff) if not known.isEmpty() else articles


def author_sources(articles: DataFrame) -> DataFrame:
    """Rows with usable full names, with only abbreviated names, with neither."""
    usable = lambda c: ~X.is_missing(F.col(f"`{c}`")) & (F.size(X.pieces(F.col(f"`{c}`"))) > 0)
    full, short = F.coalesce(usable("Author Full Names"), F.lit(False)), F.coalesce(usable("Authors"), F.lit(False))
    return articles.agg(
        F.count_if(full).alias("usable_full_names"), F.count_if(~full & short).alias("used_abbreviated_names"), F.count_if(~full & ~short).alias("unusable_rows")
    )


def source_fields(raw: DataFrame, mapping: dict[str, str], database: str) -> DataFrame:
    """For each field of an export: there or not, how many values, kept or not; one pass."""
    there = [c for c in mapping if c in raw.columns]
    counts = raw.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(there)], F.count("*").alias("n"))
    rows = [F.struct(F.lit(database).alias("database"), F.lit(c).alias("field"), F.lit(True).alias("present"), F.col(f"n{i}").alias("n_values"), F.lit(mapping[c] in S.ARTICLE_COLUMNS).alias("kept")) for i, c in enumerate(there)]
    rows += [F.struct(F.lit(database).alias("database"), F.lit(c).alias("field"), F.lit(False).alias("present"), F.lit(0).cast("bigint").alias("n_values"), F.lit(mapping[c] in S.ARTICLE_COLUMNS).alias("kept")) for c in mapping if c not in there]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def most_cited_first(df: DataFrame, group: list[str], cites: str = "cites", row: str = "id") -> DataFrame:
    """Adds ``priority``: 1 for the row with the most citations of a group, ties by row."""
    w = Window.partitionBy(*group).orderBy(F.col(cites).desc_nulls_last(), row)
    return df.withColumn("priority", F.row_number().over(w))
