import pytest
from pyspark.sql import functions as F
from scholar_spark.llm import quality


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_rules_are_learned_from_the_real_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert quality.fit_rules(docs, labels)
    judged = quality.judge_quality(docs, labels).where("NOT base_failed").join(labels, "doc_id")
    n = {(r["quality"], r["kept"]): r["n"] for r in judged.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert n.get((0, True), 0) <= 0.05 * n[0, False] and n.get((1, False), 0) <= 0.005 * n[1, True]
