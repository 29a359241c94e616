"""An index that grows by batches of pages.

A batch is parsed once (accepted, rejected, counts), its documents get ids that
go on after the earlier ones, and its term counts and document frequencies are
written to the batch's own folder.  Nothing of earlier batches is read again to
add one.  Postings are merged when they are asked for: term counts of all
batches, document frequencies and N summed over the batches.

A batch that is run again writes the same folder; batches are added in order.
Rejected pages stay in the batch's ``rejects``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators import index, parse

DOCS, TERMS, DF, REJECTS, COUNTS = "docs", "terms", "df", "rejects", "counts"


def _read(spark: SparkSession, root: str, part: str, batches: int) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{part}/{i}" for i in range(batches)])


def append(root: str, number: int, pages: DataFrame, id_col: str = "page_id") -> None:
    """Adds ``pages`` (page_id, url, html) as batch ``number`` (from 0)."""
    spark = pages.sparkSession
    first = _read(spark, root, COUNTS, number).agg(F.sum("accepted")).first()[0] if number else 0
    docs, rejects, counts = parse.parse_corpus(pages, id_col)
    named = parse.assign_doc_id(docs.withColumnRenamed("doc_id", "page_id"), "page_id") \
        .withColumn("doc_id", F.col("doc_id") + first)
    named.select("doc_id", "page_id", "title", "url", "content").write.mode("overwrite").parquet(f"{root}/{DOCS}/{number}")
    rejects.write.mode("overwrite").parquet(f"{root}/{REJECTS}/{number}")
    index.postings_tf(spark.read.parquet(f"{root}/{DOCS}/{number}")).write.mode("overwrite").parquet(f"{root}/{TERMS}/{number}")
    index.doc_frequency(spark.read.parquet(f"{root}/{TERMS}/{number}")).write.mode("overwrite").parquet(f"{root}/{DF}/{number}")
    spark.createDataFrame([(counts["accepted"], counts["rejected"])], "accepted long, rejected long") \
        .coalesce(1).write.mode("overwrite").parquet(f"{root}/{COUNTS}/{number}")


def documents(spark: SparkSession, root: str, batches: int) -> DataFrame:
    """(doc_id, page_id, title, url, content) of all batches."""
    return _read(spark, root, DOCS, batches)


def postings(spark: SparkSession, root: str, batches: int) -> DataFrame:
    """(word, doc_id, tf, idf, weight) of all batches, as ``index.build_postings``."""
    n = _read(spark, root, COUNTS, batches).agg(F.sum("accepted")).first()[0]
    df = _read(spark, root, DF, batches).groupBy("word").agg(F.sum("df").alias("df"))
    return _read(spark, root, TERMS, batches).join(df.select("word", F.expr(f"ln(CAST({n}L div df AS DOUBLE))").alias("idf")), "word") \
        .select("word", "doc_id", "tf", "idf", (F.col("tf") * F.col("idf")).alias("weight"))
