"""Driver tables and the logical inputs built from them.

All readers are plain ``spark.read.parquet``; Catalyst prunes columns and
pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw HTML corpus: (page_id, url, html)."""
    return table(spark, sf_dir, "pages")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Already-parsed bodies: (doc_id, text, lang, source, n_chars)."""
    return table(spark, sf_dir, "documents")


def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the document-table shape (doc_id, title, url, content).

    Title = first line of the text, url = ``source/doc_id``, content = text
    (so, as for HTML pages, the title text is part of the body).
    """
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id"),
        F.split(F.col("text"), "\n", 2).getItem(0).alias("title"),
        F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("content"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query batch from ``benchmark``: (query_id, query)."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def conversation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query batch from the user turns of ``conversations``: (query_id, query)."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
                    F.col("text").alias("query"))
