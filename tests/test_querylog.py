"""Cache sessions and hit/miss labels, batch and stream."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trawl.operators import querylog as QL

from conftest import SF_SMALL

T0 = datetime(2024, 1, 1)


def log_frame(spark, events):
    rows = [(i, T0 + timedelta(seconds=s), u, t) for i, (s, u, t) in enumerate(events)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")


def brute(events, ttl=1800):
    """Plain Python: per key in time order, hit iff gap <= ttl."""
    out, last = {}, {}
    for i, (s, u, t) in sorted(enumerate(events), key=lambda x: (x[1][1], x[1][2], x[1][0], x[0])):
        k = (u, t)
        out[i] = k in last and s - last[k] <= ttl
        last[k] = s
    return out


def test_boundaries(spark):
    ev = log_frame(spark, [(0, 1, "q"), (1799, 1, "q"), (1800, 1, "q"), (3601, 1, "q")])
    lab = {r["lookup_id"]: r["hit"] for r in QL.cache_labels(ev, ["user_id", "event_type"]).collect()}
    assert lab == {0: False, 1: True, 2: True, 3: False}
    ses = sorted((r["session_start_us"], r["lookups"], r["hits"], r["session_end_us"])
                 for r in QL.cache_sessions(ev, ["user_id", "event_type"]).collect())
    assert [s[1:3] for s in ses] == [(3, 2), (1, 0)]
    assert ses[0][3] - ses[0][0] == 3600 * 10**6          # last look-up + expiry


def test_hot_key_across_slabs_matches_brute_force(spark):
    rnd = random.Random(7)
    events, t = [], 0
    for _ in range(400):
        t += rnd.choice([5, 30, 600, 1799, 1800, 1801, 4000])
        events.append((t, 1 if rnd.random() < 0.7 else 2, "q"))   # key 1 is hot
    ev = log_frame(spark, events)
    for slab in (60, 3600, 10**6):
        lab = {r["lookup_id"]: r["hit"] for r in
               QL.cache_labels(ev, ["user_id", "event_type"], slab_seconds=slab).collect()}
        assert lab == brute(events)
        n_sessions = QL.cache_sessions(ev, ["user_id", "event_type"], slab_seconds=slab).count()
        assert n_sessions == sum(1 for v in brute(events).values() if not v)


def test_stream_equals_batch_on_closed_sessions(spark):
    from trawl.streaming import cache_sessions as CS

    keys = ["user_id", "event_type"]
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    batch = QL.cache_sessions(ev, keys)
    stream = CS.run_available(spark, f"{SF_SMALL}/events.parquet", keys)
    max_us = ev.select(QL.epoch_micros(ev, "ts").alias("u")).agg({"u": "max"}).first()[0]
    closed = batch.where(batch.session_end_us <= max_us - 1800 * 10**6)
    cols = keys + ["session_start_us", "session_end_us", "lookups", "hits", "misses"]
    assert sorted(tuple(r) for r in stream.select(*cols).collect()) == \
        sorted(tuple(r) for r in closed.select(*cols).collect())
    assert stream.count() > 0


def test_merged_stream_equals_batch_in_any_order_of_files(spark, tmp_path):
    from trawl.streaming import cache_sessions as CS

    rnd, events, t = random.Random(5), [], 0
    for _ in range(400):
        t += rnd.choice([5, 600, 1799, 1800, 1801, 4000])
        events.append((t, rnd.choice([1, 1, 1, 2, None]), rnd.choice(["q", "q", None])))
    keys = ["user_id", "event_type"]
    ev = log_frame(spark, events).withColumn("ts", F.when(F.col("event_id") % 97 > 0, F.col("ts")))
    cols = keys + ["session_start_us", "session_end_us", "lookups", "hits", "misses"]
    want = sorted(map(str, map(tuple, QL.cache_sessions(ev, keys).select(*cols).collect())))
    for name, file in (("late", (F.lit(7) - F.col("event_id") / 50).cast("int")), ("mixed", F.col("event_id") % 4)):
        path = str(tmp_path / name)
        parts = ev.withColumn("f", file)
        for f in sorted(r[0] for r in parts.select("f").distinct().collect()):
            parts.where(F.col("f") == f).drop("f").coalesce(1).write.mode("append").parquet(path)
        got = CS.run_merged(spark, path, keys, max_files_per_trigger=3)
        assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == want, name


def test_merged_stream_of_no_rows(spark, tmp_path):
    from trawl.streaming import cache_sessions as CS

    log_frame(spark, [(0, 1, "q")]).limit(0).write.parquet(str(tmp_path / "none"))
    assert CS.run_merged(spark, str(tmp_path / "none"), ["user_id"]).count() == 0


def test_streams_leave_the_session_as_it_is(spark):
    from trawl.streaming import cache_sessions as CS

    option = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(option)
    CS.run_available(spark, f"{SF_SMALL}/events.parquet", ["event_type"])
    assert spark.conf.get(option) == before
