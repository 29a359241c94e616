"""Token tables from a documents DataFrame.

Tokens are produced per row with ``regexp_extract_all`` (JVM-side) and
exploded with their position; nothing here shuffles except where a per-
document running sum is asked for (see ``token_offsets``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.session import bounded_broadcast, materialize, spread


# Text of a partition of ``by_document``: its tokens, some tens of bytes a character,
# are sorted and counted in a task's memory.
PARTITION_BYTES = 4 << 20


def by_document(docs: DataFrame, id_col: str = "doc_id", partitions: int | None = None,
                text_col: str = "text") -> DataFrame:
    """Hash-partition whole documents by id once.

    Every later per-document step (running offsets, per-document word counts,
    co-occurrence edges, TextRank groups) then finds its required distribution
    already satisfied and runs without another exchange.  Shuffling the text
    once is cheaper than shuffling token-sized rows at each step.

    The number of partitions follows the summed bytes of the text.  Left to AQE,
    partitions are merged by their compressed bytes: few tasks, each with a
    hundred times that in tokens, which it sorts on disk.
    """
    return docs.repartition(partitions or text_partitions(docs, text_col), F.col(id_col))


def text_partitions(docs: DataFrame, text_col: str = "text", each: int | None = None) -> int:
    """Partitions that the summed bytes of the text ask for."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (each or PARTITION_BYTES)))


def by_own_id(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id no other row has, and those that share theirs or have none (None if there are none)."""
    shared = materialize(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
                         .select(F.col(id_col).alias("_id")), "shared_ids")
    n = shared.count()
    if not n:
        return docs, None
    shared = bounded_broadcast(shared, n, 16)
    alone, together = (docs.join(shared, F.col(id_col).eqNullSafe(F.col("_id")), how) for how in ("left_anti", "left_semi"))
    return alone, materialize(together, "shared_rows")


def tokens(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, word) for every token, 0-based ``pos``."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.posexplode(T.latin_tokens(text_col)).alias("pos", "word"))


def separator_pattern(separators: str = T.DEFAULT_SEPARATORS) -> str:
    """Regex of the pieces between separators and of the separators themselves."""
    if len(set(separators)) != len(separators):
        raise ValueError("duplicate separator")
    if not separators:
        raise ValueError("empty separator set")
    cls = "".join("\\" + c if c in "\\^]-[" else c for c in separators)
    return f"[^{cls}]+|[{cls}]"


def presplit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             separators: str = T.DEFAULT_SEPARATORS) -> DataFrame:
    """Pieces between separators; every separator is a piece of its own.

    ``separators`` is a set of characters; repeats are rejected like the
    reference's separator reset.
    """
    pattern = separator_pattern(separators)
    valid = F.call_function("is_valid_utf8", F.col(text_col))  # invalid UTF-8 -> no pieces
    return docs.where(valid).select(F.col(id_col).alias("doc_id"),
                       F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0))
                       .alias("pos", "piece"))


def token_offsets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, word, offset, unicode_offset, unicode_length).

    ``offset`` is the byte offset and ``unicode_offset`` the code-point offset
    of the token; both are running sums over the preceding tokens of the same
    document.  The window is partitioned by document, so with ``by_document``
    upstream it needs no exchange; a single document never spans tasks.
    """
    t = tokens(docs, text_col, id_col)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return t.select(
        "doc_id", "pos", "word",
        F.coalesce(F.sum(F.octet_length("word")).over(w), F.lit(0)).cast("long").alias("offset"),
        F.coalesce(F.sum(F.char_length("word")).over(w), F.lit(0)).cast("long").alias("unicode_offset"),
        F.char_length("word").cast("long").alias("unicode_length"),
    )


def code_points(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, ch, code, byte_len): one row per code point.

    Rows of text that is not valid UTF-8 produce nothing (``is_valid_utf8``
    on the binary form).
    """
    valid = F.call_function("is_valid_utf8", F.col(text_col).cast("binary"))
    src = spread(docs.select(id_col, text_col), basis=docs).where(valid)
    chars = F.slice(F.split(F.col(text_col), ""), 1, F.char_length(F.col(text_col)))
    return src.select(F.col(id_col).alias("doc_id"), F.posexplode(chars).alias("pos", "ch")) \
              .select("doc_id", "pos", "ch", F.ascii("ch").cast("long").alias("code"),
                      F.octet_length("ch").cast("long").alias("byte_len"))
