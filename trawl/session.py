"""Session construction and a few cluster-safe helpers.

Nothing here hides Spark: it is the configuration a Spark user would set for
this workload (AQE on, skew-join handling on, Arrow for the few Pandas UDFs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults aimed at both local tests and large clusters.  On a cluster the
# submitter's own settings win: ``getOrCreate`` keeps an existing session.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # token arrays of long documents are large; keep Arrow batches moderate
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "trawl", extra: dict | None = None) -> SparkSession:
    """Build a session with the settings this engine expects; one that runs
    already, or was submitted with settings of its own, keeps those."""
    given = SparkSession.getActiveSession()
    if given is not None:
        for k, v in {**({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}),
                     **(extra or {})}.items():
            if given.conf.isModifiable(k):
                given.conf.set(k, v)
        return given
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.driver.memory"] = os.environ.get("TRAWL_DRIVER_MEMORY", "16g")
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit
        SparkContext._ensure_initialized()
        conf = {k: v for k, v in conf.items() if not SparkConf().contains(k)}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir``, set by the cluster).  When
    it is unset, a local session (tests) gets a scratch folder; elsewhere that
    is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="trawl-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path below the shared checkpoint folder for a written table."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def broadcast_threshold(spark: SparkSession) -> int:
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    raw = str(raw).strip().lower()
    mult = 1
    for suffix, m in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("k", 1 << 10),
                      ("m", 1 << 20), ("g", 1 << 30), ("b", 1)):
        if raw.endswith(suffix):
            raw, mult = raw[: -len(suffix)], m
            break
    try:
        return int(float(raw) * mult)
    except ValueError:
        return 10 << 20


def bounded_broadcast(df: DataFrame, row_bound: int, bytes_per_row: int) -> DataFrame:
    """Hint a broadcast only when a *proven* upper bound on the side's size fits.

    ``row_bound`` must be a real bound (e.g. number of queries x k), not an
    estimate.  Beyond the threshold the side is returned unchanged, so the
    planner falls back to a shuffle join (and AQE may still broadcast it at
    run time from measured sizes).
    """
    spark = df.sparkSession
    limit = broadcast_threshold(spark)
    if limit > 0 and row_bound * bytes_per_row <= limit:
        return F.broadcast(df)
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads the files instead of recomputing
    the corpus scan) and lets a result that is consumed twice be computed
    once.  Never a machine-local folder on a cluster: the path comes from
    ``spark.checkpoint.dir``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, basis: DataFrame | None = None) -> DataFrame:
    """Round-robin repartition *only* when ``df`` has fewer partitions than
    the cluster's default parallelism.

    CPU-heavy per-row work (HTML parsing, regex tokenization) runs in the scan
    stage; a file of one Parquet row group is one task.  Large inputs already
    have thousands of splits and pass through untouched, so the raw text is
    never shuffled at scale.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    # ``basis``: the plain scan ``df`` stems from; counting its partitions runs
    # nothing, while ``df.rdd`` of a plan with a broadcast would run that stage
    if (basis if basis is not None else df).rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
