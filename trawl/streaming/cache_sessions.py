"""Cache sessions over a stream of look-ups (Structured Streaming), two ways.

``run_available``: ``withWatermark`` + ``session_window`` (gap = cache expiry) in
append mode.  Spark keeps the open sessions in the state store and emits a
session once the watermark has passed its end; sessions still open when the
stream ends, and look-ups behind the watermark, are not in the result.

``run_merged``: every micro-batch is merged into a table of sessions in the
shared folder (``foreachBatch``), so the result equals the batch job's whatever
the order of the files.  A batch becomes sessions of its own first (slabs, as in
the batch job, so a hot key is not one task), which are merged with the sessions
still open.  A session that ended before the watermark is closed and not read
again by later batches.  A batch's sessions that start at or before the
watermark could touch a closed one; they go to a side table and are merged when
the result is read, only for their keys.  Each batch writes its own folders and
reads those of the batch before, so a batch that is run again after a failure
gives the same; look-ups without a time are skipped, null keys are a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions.text import CACHE_TTL_SECONDS
from trawl.operators import querylog as QL
from trawl.operators.querylog import epoch_micros
from trawl.session import materialize, scratch_path

_US = 1_000_000


def session_stream(stream: DataFrame, keys: list[str], ts_col: str = "ts",
                   ttl_seconds: int = CACHE_TTL_SECONDS, delay_seconds: int = CACHE_TTL_SECONDS
                   ) -> DataFrame:
    """Streaming DataFrame of closed sessions:
    (keys..., session_start_us, session_end_us, lookups, hits, misses)."""
    us = epoch_micros(stream, ts_col)
    ev = stream.select(*keys, F.timestamp_micros(us).alias("et"))
    agg = (ev.withWatermark("et", f"{delay_seconds} seconds")
           .groupBy(*keys, F.session_window("et", f"{ttl_seconds} seconds").alias("s"))
           .agg(F.count(F.lit(1)).alias("lookups")))
    return agg.select(*keys, F.unix_micros("s.start").alias("session_start_us"),
                      F.unix_micros("s.end").alias("session_end_us"), "lookups",
                      (F.col("lookups") - 1).alias("hits"), F.lit(1).cast("long").alias("misses"))


def source(spark: SparkSession, path: str, max_files_per_trigger: int | None = None):
    """(streaming DataFrame over the Parquet files at ``path``, their schema)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # a glob matching exactly the source keeps the file source from treating
    # a single file as its base directory
    return reader.parquet(path.rstrip("/")[:-1] + "[" + path.rstrip("/")[-1] + "]"), schema


def merge_sessions(parts: DataFrame, keys: list[str], ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """(keys..., start_us, last_us, lookups): sessions of a key that lie at most the
    expiry apart become one.  Rows are sessions, not look-ups."""
    w = Window.partitionBy(*keys).orderBy("start_us", "last_us")
    before = F.max("last_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_us") - F.col("_before") <= ttl_seconds * _US, 0).otherwise(1)
    return (parts.withColumn("_before", before).withColumn("_new", new)
            .withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "_island").agg(F.min("start_us").alias("start_us"), F.max("last_us").alias("last_us"),
                                           F.sum("lookups").alias("lookups")).drop("_island"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def merge_batch(batch: DataFrame, number: int, out: str, keys: list[str], ts_col: str, ttl_seconds: int,
                delay_seconds: int) -> None:
    """Writes batch ``number``: ``state`` (its closed and all open sessions), ``late``
    and ``mark`` (the watermark)."""
    spark = batch.sparkSession
    rows = materialize(batch.select(*keys, epoch_micros(batch, ts_col).alias("ts_us"),
                                    F.monotonically_increasing_id().alias("_id")), "stream_batch")
    own = materialize(QL.cache_sessions(rows, keys, "ts_us", "_id", ttl_seconds).select(
        *keys, F.col("session_start_us").alias("start_us"),
        (F.col("session_end_us") - ttl_seconds * _US).alias("last_us"), "lookups"), "stream_sessions")
    latest = own.agg(F.max("last_us")).first()[0]
    parts, before = own, None
    if number:
        before = spark.read.parquet(f"{out}/mark/{number - 1}").first()[0]
        if before is not None:
            parts = own.where(F.col("start_us") > before)
        parts = parts.unionByName(spark.read.parquet(f"{out}/state/{number - 1}").where("NOT closed").drop("closed"))
    own.where(F.lit(False) if before is None else F.col("start_us") <= before).write.mode("overwrite").parquet(f"{out}/late/{number}")
    mark = max([x for x in (before, None if latest is None else latest - delay_seconds * _US) if x is not None], default=None)
    closed = F.lit(False) if mark is None else F.col("last_us") + ttl_seconds * _US < mark
    merge_sessions(parts, keys, ttl_seconds).withColumn("closed", closed).write.mode("overwrite").parquet(f"{out}/state/{number}")
    spark.createDataFrame([(mark,)], "mark long").write.mode("overwrite").parquet(f"{out}/mark/{number}")


def merged_sessions(spark: SparkSession, out: str, batches: int, keys: list[str], ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """All sessions after ``batches`` micro-batches, in the columns of the batch job."""
    state = spark.read.parquet(*[f"{out}/state/{i}" for i in range(batches - 1)]).where("closed") if batches > 1 else None
    sessions = spark.read.parquet(f"{out}/state/{batches - 1}")
    sessions = (sessions if state is None else state.unionByName(sessions)).drop("closed")
    late = spark.read.parquet(*[f"{out}/late/{i}" for i in range(batches)])
    touched = materialize(late.select(*keys).distinct(), "late_keys")
    again = sessions.join(touched, _same(sessions, touched, keys), "left_semi").unionByName(late)
    rest = sessions.join(touched, _same(sessions, touched, keys), "left_anti")
    return merge_sessions(again, keys, ttl_seconds).unionByName(rest).select(
        *keys, F.col("start_us").alias("session_start_us"), (F.col("last_us") + ttl_seconds * _US).alias("session_end_us"),
        "lookups", (F.col("lookups") - 1).alias("hits"), F.lit(1).cast("long").alias("misses"))


def run_merged(spark: SparkSession, source_path: str, keys: list[str], ts_col: str = "ts",
               ttl_seconds: int = CACHE_TTL_SECONDS, delay_seconds: int = CACHE_TTL_SECONDS,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Every session of the look-ups at ``source_path``, read as a stream."""
    stream, _ = source(spark, source_path, max_files_per_trigger)
    out, seen = scratch_path(spark, "cache_sessions_merged"), []

    def step(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, out, keys, ts_col, ttl_seconds, delay_seconds)
        seen.append(number)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", out + "/_checkpoint") \
        .trigger(availableNow=True).start().awaitTermination()
    if not seen:  # an empty source has no batch
        empty = spark.read.parquet(source_path).limit(0)
        return QL.cache_sessions(empty.withColumn("_id", F.monotonically_increasing_id()), keys, ts_col, "_id", ttl_seconds)
    return merged_sessions(spark, out, max(seen) + 1, keys, ttl_seconds)


def run_available(spark: SparkSession, source_path: str, keys: list[str], ts_col: str = "ts",
                  ttl_seconds: int = CACHE_TTL_SECONDS, delay_seconds: int = CACHE_TTL_SECONDS,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the session stream over everything available at ``source_path``
    (``availableNow``), write closed sessions as Parquet in the shared
    checkpoint folder and return them as a batch DataFrame."""
    # merge sessions inside each partition before the shuffle: a hot key's
    # look-ups of one micro-batch reach the state store as a few partial sessions
    spark = spark.newSession()  # the option holds for this stream only
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    stream, schema = source(spark, source_path, max_files_per_trigger)
    out = scratch_path(spark, "cache_sessions_stream")
    query = (session_stream(stream, keys, ts_col, ttl_seconds, delay_seconds)
             .writeStream.format("parquet").outputMode("append")
             .option("path", out + "/data").option("checkpointLocation", out + "/_checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(
        "{} , session_start_us BIGINT, session_end_us BIGINT, lookups BIGINT, hits BIGINT, misses BIGINT"
        .format(", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys))
    ).parquet(out + "/data")
