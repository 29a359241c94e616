"""Query-log analysis of the answer cache's sliding expiry.

A look-up of a key is a *hit* when the previous look-up of the same key was at
most ``ttl`` seconds earlier (the expiry is reset on every hit); otherwise it
is a *miss* that starts a new cache session.  A session ends ``ttl`` seconds
after its last look-up.

Skew: a single key may hold a large share of all look-ups, so nothing here
partitions by the key alone.  Look-ups are cut into time *slabs* per key; the
previous look-up is found inside the slab (``lag`` over (key, slab)) or, for
the first look-up of a slab, from a per-slab summary table (one row per
key and slab, carried forward with a window over slabs).  Sessions are then a
plain hash aggregate with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.text import CACHE_TTL_SECONDS
from trawl.session import materialize

DEFAULT_SLAB_SECONDS = 3600
_US = 1_000_000


def epoch_micros(df: DataFrame, ts_col: str):
    """Microseconds since 1970-01-01 of the column's own clock, independent of
    the session time zone (TIMESTAMP_NTZ, TIMESTAMP or integral micros)."""
    dt = df.schema[ts_col].dataType
    if isinstance(dt, T.TimestampNTZType):
        # from date parts: no cast through the session time zone (DST-safe)
        c = f"`{ts_col}`"
        return F.expr(f"CAST(unix_date(CAST({c} AS DATE)) AS BIGINT) * 86400000000"
                      f" + (CAST(hour({c}) AS BIGINT) * 3600 + minute({c}) * 60) * 1000000"
                      f" + CAST(extract(SECOND FROM {c}) * 1000000 AS BIGINT)")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(ts_col))
    return F.col(ts_col).cast("long")


def lookups(events: DataFrame, keys: list[str], ts_col: str = "ts",
            id_col: str = "event_id", slab_seconds: int = DEFAULT_SLAB_SECONDS) -> DataFrame:
    """(keys..., lookup_id, ts_us, slab)."""
    us = epoch_micros(events, ts_col)
    return (events.select(*keys, F.col(id_col).alias("lookup_id"), us.alias("ts_us"))
            .where(F.col("ts_us").isNotNull())
            .withColumn("slab", F.floor(F.col("ts_us") / (slab_seconds * _US)).cast("long")))


def cache_labels(events: DataFrame, keys: list[str], ts_col: str = "ts", id_col: str = "event_id",
                 ttl_seconds: int = CACHE_TTL_SECONDS,
                 slab_seconds: int = DEFAULT_SLAB_SECONDS) -> DataFrame:
    """(keys..., lookup_id, ts_us, slab, prev_us, hit) -- one row per look-up.

    Look-ups at the same instant are ordered by ``id_col``; the second one is
    a hit (gap 0).  A look-up exactly ``ttl`` after the previous one is a hit.
    """
    ev = lookups(events, keys, ts_col, id_col, slab_seconds)
    local = ev.withColumn("prev_local", F.lag("ts_us").over(
        Window.partitionBy(*keys, "slab").orderBy("ts_us", "lookup_id")))
    per_slab = (ev.groupBy(*keys, "slab").agg(F.max("ts_us").alias("slab_last"))
                .withColumn("prev_slab_last", F.lag("slab_last").over(
                    Window.partitionBy(*keys).orderBy("slab")))
                .select(*keys, "slab", "prev_slab_last"))
    prev = F.coalesce(F.col("prev_local"), F.col("prev_slab_last"))
    return (local.join(per_slab, [*keys, "slab"])
            .withColumn("prev_us", prev)
            .withColumn("hit", F.col("prev_us").isNotNull()
                        & (F.col("ts_us") - F.col("prev_us") <= ttl_seconds * _US))
            .drop("prev_local", "prev_slab_last"))


def with_session_start(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``session_start_us``: the time of the latest miss at or before the
    look-up (the miss that opened its session)."""
    labels = materialize(labels, "cache_labels")  # read twice
    miss_ts = F.when(~F.col("hit"), F.col("ts_us"))
    local = labels.withColumn("local_start", F.max(miss_ts).over(
        Window.partitionBy(*keys, "slab").orderBy("ts_us", "lookup_id")
        .rowsBetween(Window.unboundedPreceding, 0)))
    carry = (labels.groupBy(*keys, "slab").agg(F.max(miss_ts).alias("slab_last_miss"))
             .withColumn("carry", F.max("slab_last_miss").over(
                 Window.partitionBy(*keys).orderBy("slab")
                 .rowsBetween(Window.unboundedPreceding, -1)))
             .select(*keys, "slab", "carry"))
    return (local.join(carry, [*keys, "slab"])
            .withColumn("session_start_us", F.coalesce("local_start", "carry"))
            .drop("local_start", "carry"))


def cache_sessions(events: DataFrame, keys: list[str], ts_col: str = "ts", id_col: str = "event_id",
                   ttl_seconds: int = CACHE_TTL_SECONDS,
                   slab_seconds: int = DEFAULT_SLAB_SECONDS) -> DataFrame:
    """(keys..., session_start_us, session_end_us, lookups, hits, misses)."""
    lab = with_session_start(cache_labels(events, keys, ts_col, id_col, ttl_seconds, slab_seconds), keys)
    return (lab.groupBy(*keys, "session_start_us")
            .agg(F.count(F.lit(1)).alias("lookups"), F.max("ts_us").alias("last_us"))
            .select(*keys, "session_start_us",
                    (F.col("last_us") + ttl_seconds * _US).alias("session_end_us"),
                    "lookups", (F.col("lookups") - 1).alias("hits"), F.lit(1).cast("long").alias("misses")))
