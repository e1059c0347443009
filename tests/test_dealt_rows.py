from smsight.operators import learning as L
from smsight.session import scratch_path


def test_rows_of_a_small_file_are_dealt_by_number(spark):
    path = scratch_path(spark, "same")
    spark.range(10_000).selectExpr("id", "array_repeat(0.5D, 70) AS features").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    out = L.dealt(rows, 500)
    assert rows.rdd.getNumPartitions() < 20 and out.rdd.getNumPartitions() == 20 and out.distinct().count() == 10_000
    assert L.dealt(rows).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
