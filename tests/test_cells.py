"""Where the cells of a large table lie."""

from pyspark.sql import functions as F
from scholar_spark.operators import factors


def test_cells_lie_by_the_side_that_is_summed(spark):
    cells = factors.Cells(spark.createDataFrame([(i, f"t{j}", 1.0 + i * j) for i in range(20) for j in range(9)], "id bigint, term string, tf double"))
    assert set(cells.stored) == {"id", "term"}
    for side in ("id", "term"):
        found = cells.stored[side].df.select(side, F.input_file_name().alias("file")).groupBy(side).agg(F.count_distinct("file").alias("n"))
        assert {r["n"] for r in found.collect()} == {1}
    cells.drop()
