"""Reading exports: CSV, TAB text, tagged text and XLSX, with blank cells kept apart from missing ones.

All reading goes through Spark, so a path may be in any store. Files of one export are known by their part
number; ``row_id`` orders rows by source, part and place in the file.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from dataclasses import dataclass, field
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholar_spark import schema as S
from scholar_spark.functions import text as X
from scholar_spark.operators import linkage

_NONE = "\x01none\x01"
_BROKEN = "_broken"


class InputError(ValueError):
    pass


def extension(path: str) -> str:
    found = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if found not in S.EXTENSIONS:
        raise InputError(f"unsupported file: {path}")
    return found


def part_of(path: str) -> tuple[str, int, str] | None:
    """(base, part number, extension) of a split export's file name."""
    m = re.match(r"^(.*)_(\d+)\.(xlsx?|txt|csv)$", path.rsplit("/", 1)[-1], re.I)
    return (m[1], int(m[2]), m[3].lower()) if m else None


def _header(spark: SparkSession, path: str, sep: str, quoted: bool) -> list[str]:
    line = spark.read.option("sep", sep).option("quote", '"' if quoted else "").csv(path).limit(1).collect()
    return [(c or "").strip().lstrip("﻿") for c in line[0]] if line else []


def read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as text. Lines with too many fields are skipped, short ones padded with null.

    In reference columns an empty cell is '' (no references) and a missing-value token null; elsewhere both
    are null. Cells that a short line lacks are null everywhere.
    """
    quoted = sep == ","
    names = _header(spark, path, sep, quoted)
    if len(names) < 2:
        raise InputError(f"one column only: {path}")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names) + f", `{_BROKEN}` string"
    read = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)
    read = read.option("nullValue", _NONE).option("enforceSchema", True).option("multiLine", quoted).option("escape", '"').option("quote", '"' if quoted else "")
    df = read.schema(schema).csv(path).withColumn(S.SOURCE_FILE, F.col("_metadata.file_name"))
    # a corrupt-record column needs a cached frame; a mark of its own keeps a later read of a changed file from getting this one's rows
    df = df.withColumn("_read", F.lit(uuid.uuid4().hex)).cache()
    width = F.size(F.split(F.regexp_replace(F.col(_BROKEN), r'"(?:[^"]|"")*"', ""), re.escape(sep), -1))
    df = df.withColumn("_width", F.when(F.col(_BROKEN).isNull(), len(names)).otherwise(width)).where(F.col("_width") <= len(names))
    cells = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        if n in S.REFERENCE_COLUMNS:
            there = F.col("_width") > i
            cells.append(F.when(there & (c.isNull() | (X.strip(c) == "")), "").when(there, X.present(c)).alias(n))
        else:
            cells.append(X.present(c).alias(n))
    return df.select(*cells, S.SOURCE_FILE)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Tagged plain text (PT ... ER): one row a record, a column a tag.

    A tag starts a line and is followed by a blank; continuation lines start with three blanks. Values of
    tags with several are joined by '; ', others by a blank; repeated tags append.
    """
    lines = spark.read.option("lineSep", "\nER").text(path).select(F.col("_metadata.file_name").alias(S.SOURCE_FILE), F.monotonically_increasing_id().alias("_record"), "value")
    each = lines.select(S.SOURCE_FILE, "_record", F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    tag = F.when(F.col("line").rlike("^﻿?[A-Z][A-Z0-9] "), F.substring(F.regexp_replace("line", "^﻿", ""), 1, 2))
    said = F.when(tag.isNotNull(), F.expr("substring(regexp_replace(line, '^\ufeff', ''), 4)")).when(F.col("line").startswith("   "), F.expr("substring(line, 4)"))
    w = Window.partitionBy(S.SOURCE_FILE, "_record").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select(S.SOURCE_FILE, "_record", "i", tag.alias("new"), X.strip(said).alias("said")).withColumn("tag", F.last("new", ignorenulls=True).over(w))
    each = each.where("said IS NOT NULL AND tag IS NOT NULL AND tag NOT IN ('FN', 'VR', 'EF', 'ER')")
    values = each.groupBy(S.SOURCE_FILE, "_record", "tag").agg(F.array_sort(F.collect_list(F.struct("i", "said"))).alias("v"))
    joined = F.when(F.col("tag").isin(*S.TAGS_WITH_SEVERAL), F.array_join("v.said", "; ")).otherwise(F.array_join("v.said", " "))
    out = values.groupBy(S.SOURCE_FILE, "_record").pivot("tag").agg(F.first(joined))
    return out.orderBy(S.SOURCE_FILE, "_record").drop("_record")


def parse_xlsx(raw: bytes) -> list[list[str | None]]:
    """The first sheet's cells as text, by the standard library."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml", n))[0]
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", ns):
                column = 0
                for ch in re.match("[A-Z]+", c.get("r", "A1"))[0]:
                    column = 26 * column + ord(ch) - 64
                v, kind = c.find("m:v", ns), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                cells[column - 1] = text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """XLSX by the standard library; a file that is none is read as TAB text (some exports are misnamed)."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    try:
        rows = parse_xlsx(bytes(raw))
    except zipfile.BadZipFile:
        return read_delimited(spark, path, "\t")
    names = [(n or "").strip() for n in rows[0]]
    cells = [[*r, *[None] * (len(names) - len(r))][: len(names)] for r in rows[1:]]
    df = spark.createDataFrame(cells, ", ".join(f"`{n}` string" for n in names))
    own = [F.when(F.col(f"`{n}`").isNull(), "").otherwise(X.present(F.col(f"`{n}`"))).alias(n) if n in S.REFERENCE_COLUMNS else X.present(F.col(f"`{n}`")).alias(n) for n in names]
    return df.select(*own, F.lit(path.rsplit("/", 1)[-1]).alias(S.SOURCE_FILE))


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(rows, how they were read): comma, then TAB, then tagged text, as the file allows."""
    kind = extension(path)
    if kind in (".xls", ".xlsx"):
        return read_excel(spark, path), "excel"
    first = spark.read.text(path).limit(1).collect()
    head = (first[0]["value"] if first else "").lstrip("﻿")
    if kind == ".txt" and re.match(r"(FN|VR|PT) ", head):
        return read_tagged(spark, path), "tagged"
    try:
        df, how = (read_delimited(spark, path, ","), "comma") if kind == ".csv" else (read_delimited(spark, path, "\t"), "tab")
    except InputError:
        df, how = (read_delimited(spark, path, "\t"), "tab") if kind == ".csv" else (read_delimited(spark, path, ","), "comma")
    return df, how


def detect_source(columns) -> str:
    """Scopus if more of its signal columns are there, else WoS; neither: an error."""
    names = {str(c).strip() for c in columns}
    score = {k: len(names & set(v)) for k, v in S.SIGNALS.items()}
    if not any(score.values()):
        raise InputError("the columns are those of neither export")
    return "Scopus" if score["Scopus"] > score["WoS"] else "WoS"


def has_required(columns, source: str) -> bool:
    return any(set(option) <= set(columns) for option in S.REQUIRED[source])


def coverage(columns, source: str) -> tuple[int, int, float]:
    there = sum(c in set(columns) for c in S.RECOMMENDED[source])
    return there, len(S.RECOMMENDED[source]), 100 * there / len(S.RECOMMENDED[source])


@dataclass
class Export:
    data: DataFrame
    source: str
    files: list[dict]
    warnings: list[str] = field(default_factory=list)


def read_source(spark: SparkSession, paths: list[str], source: str | None = None, split: bool = False) -> Export:
    """One file, or the parts of a split export in the order of their numbers."""
    if split and len(paths) < 2:
        raise InputError("a split export has two files or more")
    if not split and len(paths) != 1:
        raise InputError("one file is expected")
    warnings = []
    if split:
        parts = [part_of(p) for p in paths]
        if any(p is None for p in parts):
            raise InputError("file names of a split export end in _<number>")
        if len({p[0].lower() for p in parts}) > 1 or len({p[2] for p in parts}) > 1:
            raise InputError("the files belong to several exports")
        numbers = sorted(p[1] for p in parts)
        if len(set(numbers)) < len(numbers):
            raise InputError("a part number stands twice")
        if numbers[0] != 1 or numbers[-1] - numbers[0] + 1 != len(numbers):
            warnings.append(f"parts are not 1 to n without a gap: {numbers}")
        paths = [p for _, p in sorted(zip([p[1] for p in parts], paths))]
        hashes = spark.read.format("binaryFile").load(paths).select(F.sha2("content", 256).alias("h")).groupBy("h").count().where("count > 1")
        if not hashes.isEmpty():
            warnings.append("files with the same content")
    frames, files, drawn = [], [], set()
    for i, path in enumerate(paths):
        df, how = read_export(spark, path)
        own = detect_source(df.columns)
        if source not in (None, own):
            raise InputError(f"{path} is an export of {own}, not {source}")
        if not has_required(df.columns, own):
            raise InputError(f"{path} has no titles")
        source = own
        drawn.add(tuple(sorted(df.columns)))
        files.append({"file": path.rsplit("/", 1)[-1], "source": own, "read_as": how, "part": i + 1})
        place = F.struct(F.lit(i).alias("part"), F.monotonically_increasing_id().alias("place"))
        frames.append(df.withColumn("_place", place))
    if len(drawn) > 1:
        warnings.append("the files' columns differ")
    return Export(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), source, files, warnings)


def from_frame(df: DataFrame) -> DataFrame:
    """A frame from elsewhere as a raw export; the provenance column is reserved."""
    if S.SOURCE_FILE in df.columns:
        raise InputError(f"the column {S.SOURCE_FILE} is reserved")
    return df


def summary(export: Export) -> DataFrame:
    """One row: records, columns, years, titles, DOI coverage, rows in groups of one DOI, affiliations."""
    df, table = export.data, S.SCOPUS if export.source == "Scopus" else S.WOS
    find = lambda target: F.coalesce(*[X.present(F.col(f"`{c}`")) for c, t in table.items() if t == target and c in df.columns], F.lit(None).cast("string"))
    rows = df.select(find("Publication Year").try_cast("double").alias("y"), find("Title").alias("t"), X.doi(find("DOI")).alias("d"), find("Affiliations").alias("a"))
    twice = rows.where("d IS NOT NULL").groupBy("d").count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows_sharing_doi"))
    one = rows.agg(
        F.count("*").alias("records"), F.lit(len([c for c in df.columns if c not in (S.SOURCE_FILE, "_place")])).alias("columns"), F.min("y").alias("first_year"),
        F.max("y").alias("last_year"), F.count("t").alias("titles"), (100.0 * F.count("d") / F.nullif(F.count("*"), F.lit(0))).alias("doi_pct"),
        (100.0 * F.count("a") / F.nullif(F.count("*"), F.lit(0))).alias("affiliation_pct"),
    )
    return one.crossJoin(twice)  # one row each


def harmonize(exports: list[Export]) -> DataFrame:
    """The exports as one article table with row_id (source, part and place order), numbers and provenance."""
    frames = []
    for s, e in enumerate(sorted(exports, key=lambda e: list(S.SIGNALS).index(e.source))):
        df, table = e.data, dict(S.SCOPUS if e.source == "Scopus" else S.WOS)
        if e.source == "WoS" and S.WOS_CORE_CITES not in df.columns and S.WOS_ALL_CITES in df.columns:
            table[S.WOS_ALL_CITES] = "Cited by"
        refs = [c for c in S.REFERENCE_COLUMNS if c in df.columns]
        cols = []
        for target in S.ARTICLE_COLUMNS:
            own = [F.col(f"`{c}`") for c, t in table.items() if t == target and c in df.columns]
            value = F.coalesce(*own, F.lit(None).cast("string")) if own else F.lit(None).cast("string")
            if target == "Authors":
                value = X.authors_scopus(value) if e.source == "Scopus" else X.authors_wos(value)
            elif target == "Author Full Names":
                value = X.without_ids(value)
            elif target in ("Publication Year", "Cited by"):
                value = value.try_cast("double")
            elif target == "Cited Reference Count":
                n = value.try_cast("double")
                derived = F.coalesce(*[X.reference_count(F.col(f"`{c}`")) for c in refs], F.lit(None).cast("bigint"))
                value = F.coalesce(F.when((n >= 0) & (n == F.floor(n)), n.cast("bigint")), derived)
            elif target == "Primary Database":
                value = F.lit(S.DATABASES[list(S.SIGNALS).index(e.source)])
            elif target == "Databases":
                value = F.array(F.lit(S.DATABASES[list(S.SIGNALS).index(e.source)]))
            elif target == "Source Files":
                value = F.array(F.coalesce(F.col(S.SOURCE_FILE), F.lit(""))) if S.SOURCE_FILE in df.columns else F.array().cast("array<string>")
            cols.append(value.alias(target))
        place = F.col("_place") if "_place" in df.columns else F.struct(F.lit(0).alias("part"), F.monotonically_increasing_id().alias("place"))
        frames.append(df.select(*cols, F.format_string("%01d-%06d-%015d", F.lit(s), place["part"], place["place"]).alias("row_id")))
    return reduce(DataFrame.unionByName, frames)


def field_audit(export: Export) -> DataFrame:
    """For each field that an export of its kind may have: there or not, how many values, kept or not."""
    table = S.SCOPUS if export.source == "Scopus" else S.WOS
    return linkage.source_fields(export.data, table, S.DATABASES[list(S.SIGNALS).index(export.source)])


def field_coverage(exports: list[Export]) -> DataFrame:
    """(export, source, there, recommended, pct): recommended columns that each export has; a row an export."""
    rows = [(i, e.source, *coverage(e.data.columns, e.source)) for i, e in enumerate(exports, 1)]
    return exports[0].data.sparkSession.createDataFrame(rows, "export int, source string, there int, recommended int, pct double")


def ingest(exports: list[Export], cutoff: int | None = None) -> dict[str, DataFrame]:
    """Harmonized, fused and filtered articles with the audits of each step."""
    articles = linkage.with_keys(harmonize(exports)).withColumn("DOI_raw", F.col("DOI"))
    fused = linkage.fuse(articles.drop("DOI_raw"))
    fused = fused.withColumn("DOI", X.doi(F.col("DOI")))
    kept = fused if cutoff is None else linkage.time_filter(fused, cutoff)
    return {
        "articles": kept, "fused": fused, "prisma": linkage.prisma(articles, fused), "enrichment": linkage.enrichment(fused),
        "databases": linkage.database_combinations(fused), "duplicates": linkage.duplicates(articles), "authors": linkage.author_sources(fused),
        "temporal": linkage.temporal_audit(fused, kept, cutoff, "Publication Year"), "fields": reduce(DataFrame.unionByName, map(field_audit, exports)),
        "coverage": field_coverage(exports),
    }
