from __future__ import annotations

from pyspark.sql import functions as F

from monthweave.llm.storage import hash_below, largest, without_rows
from tests.llm.cases import messy


def test_largest_takes_all_from_a_bound_on(spark):
    df = spark.range(1, 2001).select(F.col("id").cast("double").alias("v"))
    found = sorted(r.v for r in largest(df, "v", 300).collect())
    assert 280 <= len(found) <= 300 and found == [float(x) for x in range(2001 - len(found), 2001)]
    assert largest(df, "v", 5000).count() == 2000
    assert largest(df.filter("v < 0"), "v", 5).count() == 0
    # Ties that would exceed the wanted number are left out as a whole.
    assert largest(spark.range(50).select(F.lit(3.0).alias("v")), "v", 10).count() == 0


def test_hash_below_keeps_the_smallest(spark):
    df = spark.range(20000).select(F.xxhash64("id").alias("h"))
    smallest = [r.h for r in df.orderBy("h").limit(500).collect()]
    kept = df.filter(hash_below(F.col("h"), 500, 20000))
    assert [r.h for r in kept.orderBy("h").limit(500).collect()] == smallest
    assert kept.count() < 1200
    assert df.filter(hash_below(F.col("h"), 500, 300)).count() == 20000


def test_without_rows_leaves_columns_as_they_are(spark):
    docs = messy(spark)
    left = without_rows(docs, spark.createDataFrame([(0,)], "_row long"))
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    assert {r._row for r in left.collect()} == {-1}
