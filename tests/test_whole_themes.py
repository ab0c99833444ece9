import math

import pytest
from pyspark.sql import functions as F
from scholar_spark.operators import themes


def test_coherence_counts_every_term(spark):
    """More than 100,000 terms: two a topic, both in one document."""
    terms = spark.range(100_010).select((F.col("id") / 2).cast("int").alias("topic"), (F.col("id") % 2).alias("rank"), F.col("id").cast("string").alias("term"))
    docs = terms.select(F.col("topic").alias("id"), "term")
    assert themes.umass_coherence(terms, docs).first()["coherence"] == pytest.approx(math.log(2), abs=1e-9)
