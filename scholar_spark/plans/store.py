"""Ingestion kept for later runs: its tables in a shared folder, under a fingerprint of the exports and settings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholar_spark.config import resolve_config
from scholar_spark.plans.workflow import Stage, run_ingestion
from scholar_spark.sources import readers

#: Counted up whenever ingestion gives other tables for the same files and settings.
FORM = 1


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, sources: list[list[str]], config: dict) -> str:
    """Hash of the files' paths, lengths and times of change, export by export, and of what ingestion is set to.

    Read from the file system's listing: no file is opened and no job runs.
    """
    exports = []
    for paths in sources:
        files = []
        for path in paths:
            p, system = _path(spark, path)
            status = system.getFileStatus(p)
            files.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
        exports.append(sorted(files))
    settings = {k: config[k] for k in ("as_of_year", "apply_time_filter")}
    return hashlib.sha256(json.dumps([FORM, sorted(exports), settings], sort_keys=True).encode()).hexdigest()


def counted_write(df: DataFrame, path: str) -> int:
    """Write ``df`` and return its rows, counted by the writing job itself."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def stored_ingestion(spark: SparkSession, sources: list[list[str]], config: dict | None, store: str) -> Stage:
    """Ingestion of the exports (lists of files, several for a split one), from ``store`` if nothing has changed.

    A first run writes each table and, last of all, a description; a folder without one, as a lost driver
    leaves it, is written anew. Changed files or settings have another folder. The metadata say whether the
    tables were reused, and how many rows each has.
    """
    config = resolve_config(config)
    folder = f"{store.rstrip('/')}/ingestion-{fingerprint(spark, sources, config)}"
    mark, system = _path(spark, f"{folder}/description/_SUCCESS")
    if system.exists(mark):
        said = json.loads(spark.read.schema("value string").text(f"{folder}/description", wholetext=True).first()[0])
        reused = True
    else:
        exports = [readers.read_source(spark, paths, split=len(paths) > 1) for paths in sources]
        stage = run_ingestion(exports, config)
        counts = {name: counted_write(df, f"{folder}/{name}") for name, df in stage.tables.items()}
        schemas = {name: df.schema.json() for name, df in stage.tables.items()}
        said = {"counts": counts, "schemas": schemas, "warnings": stage.warnings, "cutoff": stage.metadata["cutoff"]}
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/description")
        reused = False
    tables = {name: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{folder}/{name}") for name, schema in said["schemas"].items()}
    about = {"cutoff": said["cutoff"], "reused": reused, "counts": said["counts"], "documents": said["counts"]["articles"]}
    return Stage(tables["articles"], tables, said["warnings"], about)
