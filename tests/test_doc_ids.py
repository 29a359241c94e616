from pyspark.sql import functions as F

from trawl.operators.parse import assign_doc_id


def test_ids_are_dense_and_in_path_order_over_many_partitions(spark):
    n = 200_000
    path = F.format_string("p%08d", (F.col("id") * 7919) % n)
    df = spark.range(0, n, 1, 9).select(path.alias("path"), F.repeat(F.lit("x"), 60).alias("content"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = assign_doc_id(df)
        bad = out.where(F.col("doc_id") != F.expr("CAST(substring(path, 2) AS BIGINT)")).count()
        assert (out.count(), out.select("doc_id").distinct().count(), bad) == (n, n, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
