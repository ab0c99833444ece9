"""Helpers shared by the corpus operators: written intermediate tables, Arrow batches, components."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers get and hand over a batch once its values hold this many bytes, so that memory stays level
#: whatever the number of long texts in a row group.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096
#: The session's limit of the batches that Python workers get. By itself it is 64 MB: a whole task's texts at once,
#: which are then held in the JVM, doubled as they grow, and in the worker.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets one in the warehouse folder; a cluster gets an error,
    as no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return found


def free_name(name: str, names: list[str]) -> str:
    """``name``, with underscores before it until it is none of ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Rows of a few longs that may be sent to every executor; beyond it a shuffle join does the same.
SENT_ROWS = 1_500_000


def sent(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for sending to all executors if it has at most SENT_ROWS rows (``rows``, where known)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SENT_ROWS else df


class Written:
    """A table written once to the shared folder: it cuts lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/scholar_spark/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no pending plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of a batch to BATCH_BYTES; a row larger than that is a batch by itself."""
    if int(spark.conf.get(BATCH_SETTING).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[dict], Iterable[tuple]]], schema: str, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Apply a row function to ``df`` in Arrow batches of bounded size.

    ``make()`` runs once in each task and returns a function from a row (a dict of the input columns)
    to output tuples, in the order of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    bounded_batches(df.sparkSession)

    def mapped(each, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(names, columns)}
                for out in each(row):
                    rows.append(out)
                    held += 64 + sum(8 * len(x) if isinstance(x, np.ndarray) else len(x) for x in out if isinstance(x, (str, bytes, list, np.ndarray)))
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield to_batch(rows, arrow)
                        rows, held = [], 0
        if rows:
            yield to_batch(rows, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        each = make()
        release()
        yield from mapped(each, batches)
        del each
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give the memory that a task has freed back to the system: idle workers live on beside other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


#: Edges that one executor task may join by union-find (16 bytes each).
ONE_TASK = 500_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", native: bool = False) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns): root is the smallest node reachable.

    A counted, small number of edges is joined by union-find in one executor task (unless only DataFrame
    operations may be used). Beyond it, large-star and small-star steps alternate until the edges stop
    changing (O(log^2 n) rounds). Their minima are taken with map-side combine and joined back, so a star
    centre with very many neighbours is a skewed join that adaptive execution splits. Nothing is collected
    but counts.
    """
    now = Written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    found = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    if not native and found[0] <= ONE_TASK:
        return Written(now.df.coalesce(1).mapInArrow(_union_find, "node bigint, root bigint"), "roots").df
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, F.least(F.col("u"), F.col("m"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = Written(large.where("u <> v").distinct(), "edges")
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _least(large.df, F.col("m")).select(F.explode(pairs).alias("e"))
        after = Written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now.drop()
        large.drop()
        now, mark = after, found
        found = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == mark or not found[0]:
            stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _least(edges: DataFrame, m: Column) -> DataFrame:
    """Adds m: from the least v of each u."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("least")), "u").withColumn("m", F.col("least")).withColumn("m", m).drop("least")


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x):
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(u, u)
            root.setdefault(v, v)
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    nodes = list(root)
    for i in range(0, len(nodes), 65_536):
        part = nodes[i : i + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["node", "root"])
    root.clear()
    release()
