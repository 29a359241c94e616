"""Corpus pipeline: quality rules, line dedup, near-dedup, packing.

Each stage takes what its predecessor kept, written as Parquet in the shared
folder and read again; all but the last return the columns of documents.

Rows with a null doc_id go through all stages; near-dedup keeps each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import lines, neardup, pack, quality
from trawl.llm.catalog import tokenizer_file
from trawl.session import materialize
from trawl.sources.tables import documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the perplexity band."""
    return quality.kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate; one that loses all its words
    (each line is elsewhere) goes."""
    out = lines.dedup(docs, short_chars=lines.SHORT_CHARS)
    return (out.where(r"n_removed = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
            .withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars"))
                        .otherwise(F.length("text")).cast("long")).select(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    kept = neardup.groups(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return pack.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup),
          ("MinHash near-dedup", near_dedup), ("packing", packing)]

# tokenizing has no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
