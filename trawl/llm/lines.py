"""Line dedup by distinct-site spread.

Per line hash a HyperLogLog sketch of the sites is built by partial aggregation
and merged in the shuffle.  Lines whose estimate is near the threshold get an
exact distinct count; lines on ``min_sites`` sites or more are boilerplate, and
all but their first occurrence (smallest doc_id, then line number) go.

A line counts from ``min_sites`` sites on if it has ``MIN_WORDS`` words.  Others
are kept, or with ``short_chars`` count from ``short_chars / code points`` sites
on (``min_sites`` at least): the shorter a line, the more sites must have it.
The SQL of op3_line_dedup keeps them; the pipeline gives ``SHORT_CHARS``.  Blank
lines never count.  Lines are compared after trimming.  Null or empty text: kept as it is.  Null site: the
site "".  Rows with a null doc_id are kept unchanged.  A doc_id that repeats:
its rows are treated alike, each by its own text.  An input column n_removed is
replaced; any other extra column is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import salt
from trawl.session import materialize

MIN_SITES = 2
MIN_WORDS = 5
SHORT_CHARS = 160
NEAR = 0.25  # relative band around the threshold that is counted exactly; HLL error at 2^12 is 1.6 %
SALTS = 32


def _lines(docs: DataFrame, site: str, min_sites: int = MIN_SITES, short_chars: int | None = None) -> DataFrame:
    """(doc_id, pos, h, site, need) of every line that counts from ``need`` sites on."""
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        i.alias("pos"), F.trim(x).alias("s")))

    def enough(x):
        return F.size(F.split(x.s, r"\s+")) >= MIN_WORDS

    def need(x):
        if short_chars is None:
            return F.lit(min_sites).cast("long")
        return F.when(enough(x), F.lit(min_sites).cast("long")).otherwise(
            F.greatest(F.lit(min_sites).cast("long"), F.ceil(F.lit(short_chars) / F.length(x.s))))

    counts = F.filter(parts, enough if short_chars is None else lambda x: enough(x) | x.s.rlike(r"\S"))
    rows = docs.select("doc_id", F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
                       F.explode(F.transform(counts, lambda x: F.struct(
                           x.pos.alias("pos"), F.xxhash64(x.s).alias("h"), need(x).alias("need")))).alias("l"))
    return rows.where("doc_id IS NOT NULL").select("doc_id", "site", "l.pos", "l.h", "l.need")


def boilerplate(lines: DataFrame) -> DataFrame:
    """(h, first struct(doc_id, pos)) of the lines on ``need`` sites or more."""
    sketch = lines.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(12))).alias("est"),
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"), F.max("need").alias("need"))
    seen = materialize(sketch.where(f"n >= 2 AND est >= need * {1 - NEAR}")
                       .select("h", "est", "first", "need"), "line_spread")
    near = seen.where(f"est <= need * {1 + NEAR}").select("h")
    exact = (lines.join(near, "h", "left_semi").groupBy("h", "site").count()
             .groupBy("h").agg(F.count(F.lit(1)).alias("sites")))
    return (seen.join(exact, "h", "left")
            .where("coalesce(sites, est) >= need").select("h", "first"))


def dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES,
          short_chars: int | None = None) -> DataFrame:
    """``docs`` with the text less its boilerplate lines, and n_removed."""
    docs = docs.drop("n_removed")
    mark = "_gone"
    while mark in docs.columns:
        mark += "_"
    lines = materialize(_lines(docs, site, min_sites, short_chars), "lines")
    bad = boilerplate(lines).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = (lines.withColumn("salt", salt("doc_id", SALTS)).join(bad, ["h", "salt"])
            .where("first.doc_id <> doc_id OR first.pos <> pos")
            .groupBy("doc_id").agg(F.collect_set(F.struct("pos", "h")).alias(mark)))
    out = docs.join(gone, "doc_id", "left")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("s"))),
                    lambda x: ~F.array_contains(F.col(mark), F.struct(
                        x.pos.alias("pos"), F.xxhash64(F.trim(x.s)).alias("h"))))
    text = F.when(F.col(mark).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda x: x.s), "\n"))
    n = F.when(F.col(mark).isNull(), 0).otherwise(F.size(F.split("text", "\n")) - F.size(kept)).cast("long")
    return out.withColumn("n_removed", n).withColumn("text", text).drop(mark) \
        .select(*[F.col(c) for c in docs.columns], "n_removed")
