"""HTML page -> document row (title, url, content), as one projection.

Parse steps are per-row built-in expressions: no shuffle, whole-stage codegen,
parallel over all scan partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.session import materialize, scratch_path, spread


def parsed_columns(html_col: str = "html"):
    """(title, content) columns of a page after the whole-file read rule."""
    html = T.ensure_final_newline(html_col)
    return T.html_title(html).alias("title"), T.html_body(html).alias("content")


def parse_corpus(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> tuple[DataFrame, DataFrame, dict]:
    """(documents, rejects, counts) from one pass over the pages.

    The parsed pages are written once, partitioned by outcome; the counts
    (rows, accepted, rejected) are observed in that write.  It has no shuffle, so
    its tasks are result tasks and a task that is run again counts once.  All
    that follows (index, N, rejects) reads what was written, not the pages.
    """
    title, content = parsed_columns(html_col)
    # spread before the parse, which else runs in the tasks of the scan
    raw = spread(pages.select(*dict.fromkeys((id_col, url_col, html_col))), basis=pages)
    parsed = raw.select(F.col(id_col).alias("doc_id"), title, F.col(url_col).alias("url"), content)
    accepted = F.coalesce(F.col("title") != "", F.lit(False))
    seen = Observation()
    path = scratch_path(pages.sparkSession, "parsed")
    parsed.withColumn("accepted", accepted).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected")).write.partitionBy("accepted").parquet(path)
    counts = seen.get
    out = pages.sparkSession.read.schema(parsed.withColumn("accepted", accepted).schema).parquet(path)
    docs = out.where("accepted").drop("accepted")
    return docs, out.where("NOT accepted").select("doc_id", "url", F.lit("title").alias("reason")), counts


def parse_documents(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                    html_col: str = "html") -> DataFrame:
    """Accepted documents: (doc_id, title, url, content); a page with no or an
    empty ``<title>`` is rejected."""
    title, content = parsed_columns(html_col)
    return (pages.select(F.col(id_col).alias("doc_id"), title, F.col(url_col).alias("url"),
                         F.col(html_col).alias("_html"))
            .where(F.col("title") != "")
            .select("doc_id", "title", "url", parsed_columns("_html")[1]))


def parse_rejects(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """Rejected pages with a reason: (doc_id, url, reason)."""
    title = T.html_title(T.ensure_final_newline(html_col))
    return (pages.select(F.col(id_col).alias("doc_id"), F.col(url_col).alias("url"),
                         title.alias("title"))
            .where(F.col("title") == "")
            .select("doc_id", "url", F.lit("title").alias("reason")))


def assign_doc_id(df: DataFrame, order_col: str = "path", id_col: str = "doc_id") -> DataFrame:
    """Dense 0-based ids in ``order_col`` order, without a single-partition window.

    Range-partition and sort by ``order_col``; the position inside a partition
    comes from ``monotonically_increasing_id`` (partition index in the upper
    bits).  The rows are written before they are sampled for the range bounds,
    which else scans and parses the input a second time.  The marked rows are
    written once before anything reads them: the
    range bounds are sampled and AQE may merge partitions, so two runs of that
    plan need not agree.  Each partition's start offset is a running sum over
    the per-partition row counts -- one row per partition, a bounded broadcast.
    """
    ordered = materialize(df, "unnumbered").repartitionByRange(F.col(order_col)).sortWithinPartitions(order_col)
    marked = materialize(ordered.withColumn("_mid", F.monotonically_increasing_id())
                         .withColumn("_pid", F.shiftright(F.col("_mid"), 33)), "doc_id")
    counts = marked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    out = marked.join(F.broadcast(offsets), "_pid").withColumn(
        id_col, F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    return out.drop("_pid", "_mid", "_off")
