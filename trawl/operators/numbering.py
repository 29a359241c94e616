"""Row numbers inside groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import bounded_broadcast, materialize


def numbered(rows: DataFrame, group: str, *order: Column, name: str = "idx") -> DataFrame:
    """``rows`` plus ``name``, the 0-based place in its ``group`` by ``order``.

    Range partitions number their own sorted rows; where a group begins in a
    partition is a running sum over one row a partition and group.  A group that
    holds a third of all rows is spread over a third of the partitions.
    """
    dealt = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    marked = materialize(dealt.withColumn("_at", F.monotonically_increasing_id())
                         .withColumn("_part", F.shiftright("_at", 33)), "numbered")
    runs = materialize(marked.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "runs")
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    placed = runs.select("_part", group, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"))
    size = runs.agg(F.count(F.lit(1)), F.max(F.octet_length(F.col(group).cast("string")))).first()
    keyed = marked.withColumnRenamed(group, "_g").join(
        bounded_broadcast(placed.withColumnRenamed(group, "_h").withColumnRenamed("_part", "_p"), size[0], 48 + (size[1] or 0)),
        (F.col("_part") == F.col("_p")) & F.col("_g").eqNullSafe(F.col("_h")))
    return keyed.withColumn(name, F.col("_at") + F.col("_base")).withColumnRenamed("_g", group) \
        .select(*[c for c in rows.columns], name)
