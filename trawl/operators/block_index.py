"""Postings in blocks, bucketed by word, with an exact early stop.

A word's postings are ordered by weight and cut into blocks of ``BLOCK``; a
block is one row with its largest weight and an array of documents.  The table
is bucketed and sorted by word: a batch of queries prunes the buckets and row
groups of all other words, and the join on the word needs no exchange of the
postings.

A search reads block 0 of every query word, then block 1 and so on, but only
of words whose block could still bring a document into the query's first k: a
document scores the largest weight of its words, so a block whose largest
weight is below the k-th best cannot.  The answer is exact for any k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.operators import search as S
from trawl.operators.index import rank_key
from trawl.operators.numbering import numbered
from trawl.session import bounded_broadcast, materialize, scratch_path

BLOCK = 128
BUCKETS = 16
PRUNED_WORDS = 1000  # query words up to this number are named in the scan's filter


def blocks(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """(word, block, top, n, docs): blocks of postings in order of falling weight."""
    rows = numbered(postings.select("word", "doc_id", "weight", rank_key().alias("_key")), "word",
                    F.col("_key").desc(), F.col("doc_id").asc())
    return (rows.withColumn("block", F.expr(f"CAST(idx div {size} AS INT)"))
            .groupBy("word", "block").agg(
                F.max("_key").alias("top"), F.count(F.lit(1)).alias("n"),
                F.array_sort(F.collect_list(F.struct("idx", "doc_id", "weight"))).alias("docs")))


def write_blocks(rows: DataFrame, buckets: int = BUCKETS) -> str:
    """The blocks as a table bucketed and sorted by word in the shared folder; its
    name.  ``drop`` forgets the table when its last search is done."""
    path = scratch_path(rows.sparkSession, "blocks")
    name = "trawl_" + path.rsplit("/", 1)[1].replace("-", "_")
    rows.repartition(buckets, "word").write.bucketBy(buckets, "word").sortBy("word", "block") \
        .option("path", path).saveAsTable(name)
    return name


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def reading(table: DataFrame, active: DataFrame, block: int, words: list[str] | None, n_active: int) -> DataFrame:
    """(query_id, word, n, docs) of the blocks numbered ``block`` of the active
    (query_id, word, least) whose largest weight may still count."""
    rows = table.where(F.col("block") == block)
    if words is not None:
        rows = rows.where(F.col("word").isin(words))
    found = rows.join(bounded_broadcast(active, n_active, S.QUERY_WORD_ROW_BYTES), "word")
    return found.where(F.col("least").isNull() | (F.col("top") >= F.col("least")))


def best_hits(qwords: DataFrame, table: DataFrame, k: int, size: int = BLOCK) -> tuple[DataFrame, list[int]]:
    """((query_id, doc_id, word, weight, rank), blocks read for queries in each
    round); the first ``k`` documents of each query."""
    active = materialize(qwords.select("query_id", "word", F.lit(None).cast("double").alias("least")), "query_words")
    held, read = None, []
    by_query = Window.partitionBy("query_id").orderBy(F.desc("key"), F.col("doc_id"))
    while True:
        n_active = active.count()
        if not n_active:
            break
        names = [r[0] for r in active.select("word").distinct().limit(PRUNED_WORDS + 1).collect()]
        found = materialize(reading(table, active, len(read), names if len(names) <= PRUNED_WORDS else None, n_active)
                            .select("query_id", "word", "n", "docs"), "blocks_read")
        read.append(found.count())
        new = found.select("query_id", "word", F.explode("docs").alias("d")).select(
            "query_id", "d.doc_id", "word", "d.weight", rank_key("d.weight").alias("key"))
        rows = new if held is None else held.select("query_id", "doc_id", "word", "weight", "key").unionByName(new)
        # a document's best word: largest weight, then the smallest word
        best = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct(-F.col("key"), "word", "weight")).alias("b")).select(
            "query_id", "doc_id", "b.word", "b.weight", rank_key("b.weight").alias("key"))
        held = materialize(best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k), "held")
        kth = held.where(F.col("rank") == k).select("query_id", F.col("key").alias("least"))
        going = found.where(F.col("n") == size).select("query_id", "word")
        active = materialize(going.join(kth, "query_id", "left").select("query_id", "word", "least"), "active_words")
    if held is None:
        held = active.select("query_id", F.lit(0).cast("long").alias("doc_id"), "word", F.col("least").alias("weight"),
                             F.lit(0).alias("rank"))
    return held.select("query_id", "doc_id", "word", "weight", "rank"), read


def search(queries: DataFrame, table: DataFrame, docs: DataFrame, k: int, size: int = BLOCK) -> DataFrame:
    """(query_id, rank, doc_id, word, weight, title, url, desc), as ``search.search``."""
    top, _ = best_hits(S.query_words(queries), table, k, size)
    return S.attach_documents(top, docs, queries.count() * k)
