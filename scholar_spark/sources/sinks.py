"""Writing results: CSV with lists as JSON, canonical containers, text reports, GraphML and a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholar_spark import schema as S
from scholar_spark.operators import graph
from scholar_spark.operators.linkage import distinct_files, known_databases


def exportable(df: DataFrame) -> DataFrame:
    """Lists and structs as JSON text, internal columns gone, provenance lists in their fixed order."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name == S.SOURCE_FILE or f.name.startswith("_"):
            continue
        if f.name == "Databases":
            c = known_databases(c)
        elif f.name == "Source Files":
            c = distinct_files(c)
        out.append((F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with a header."""
    exportable(df).write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def csv_text(df: DataFrame, most: int = 100_000) -> str:
    """A small table as one CSV text with a byte-order mark; more rows than ``most`` are an error."""
    rows = exportable(df).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them with write_csv")
    return "﻿" + rows.to_csv(index=False)


def canonical_json(value) -> str:
    """Keys and sets in order without regard to case, lists as they are."""
    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(v[k]) for k in sorted(v, key=lambda k: str(k).casefold())}
        if isinstance(v, (set, frozenset)):
            return [plain(x) for x in sorted(v, key=lambda x: str(x).casefold())]
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(value), ensure_ascii=False)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file through Spark's writers, so any store will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def graphml_text(nodes: DataFrame, edges: DataFrame, most: int = 250_000) -> str:
    n, e = nodes.limit(most + 1).collect(), edges.limit(most + 1).collect()
    if max(len(n), len(e)) > most:
        raise ValueError(f"more than {most} nodes or edges")
    return graph.graphml([r.asDict() for r in n], [r.asDict() for r in e])


@dataclass
class Manifest:
    """What each stage did; written as a table beside the outputs."""

    rows: list[tuple] = field(default_factory=list)

    def add(self, stage: str, status: str, documents: int | None = None, warnings: list[str] | None = None, detail: str = "") -> None:
        self.rows.append((stage, status, documents, "; ".join(dict.fromkeys(warnings or [])), detail))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, status string, documents bigint, warnings string, detail string")
