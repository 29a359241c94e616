"""Loaders for the dictionary-style inputs: lexicon, user lexicon, IDF table,
stop words.  Each is ``spark.read.text`` plus column expressions.

Line order (for "last line wins") is the order of the given list, then of the
file names (an entry may be a directory of part files), then of the lines, whatever
splits the files are read in: ``line_no`` is a text that sorts that way."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.text import split_fields


def _paths(paths) -> list[str]:
    if isinstance(paths, str):
        return [p for p in re.split(r"[|;]", paths) if p]
    return list(paths)


def _lines(spark: SparkSession, paths) -> DataFrame:
    """(value, line_no) over one or more files or directories."""
    frames = []
    for i, p in enumerate(_paths(paths)):
        # rows of one block are numbered in their order; blocks and files sort by where they begin
        frames.append(spark.read.text(p).select("value", F.concat(
            F.lit(f"{i:06d} "), F.col("_metadata.file_path"), F.lit("\u0001"),
            F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"), F.lit(" "),
            F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")).alias("line_no")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def load_lexicon(spark: SparkSession, paths, validate: bool = True) -> DataFrame:
    """(word, freq, tag, line_no) from ``word freq tag`` lines; a line with a
    different number of columns is an error (checked with one count)."""
    parts = split_fields("value", " ")
    lines = _lines(spark, paths).withColumn("_p", parts)
    if validate:
        bad = lines.where(F.size("_p") != 3).count()
        if bad:
            raise ValueError(f"lexicon: {bad} line(s) without exactly 3 columns")
    return lines.select(F.col("_p")[0].alias("word"), F.col("_p")[1].cast("double").alias("freq"),
                        F.col("_p")[2].alias("tag"), "line_no")


def load_user_lexicon(spark: SparkSession, paths) -> DataFrame:
    """(word, freq, tag, line_no) from user lines: word | word tag | word freq
    tag; several files may be joined by ``|`` or ``;``; empty lines skipped."""
    from trawl.operators.lexicon import parse_user_lines

    return parse_user_lines(_lines(spark, paths))


def load_idf(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """((word, idf), (n_lines)): two-column lines; malformed and empty lines
    are skipped but still count in the average's denominator; an unreadable number is 0
    (``keywords.idf_average(idf, n_lines)``)."""
    lines = _lines(spark, paths)
    parts = split_fields("value", " ")
    good = (lines.where((F.col("value") != "") & (F.size(parts) == 2))
            .select(parts[0].alias("word"), F.coalesce(parts[1].try_cast("double"), F.lit(0.0)).alias("idf"), "line_no"))
    return good, lines.select(F.count(F.lit(1)).alias("n_lines"))


def load_stop_words(spark: SparkSession, paths) -> DataFrame:
    """(word): one stop word per line."""
    return _lines(spark, paths).select(F.col("value").alias("word")).distinct()
