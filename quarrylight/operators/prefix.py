"""Running totals over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.storage import written


def running_total(df: DataFrame, order: list[str], **values: Column) -> DataFrame:
    """``df`` with a bigint column per value: the sum of that value over all rows before the row in ``order``.

    Rows are range-partitioned and written; the partitions' totals, one row each, give where each begins, and the rest is a
    window within a partition. ``order`` must be unique. An empty table gives no rows.
    """
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    sums = [F.sum(v.cast("bigint")).alias(f"{k}_") for k, v in values.items()]
    begin, rows = dict.fromkeys(values, 0), []
    for r in sorted(parts.groupBy("part_").agg(*sums).collect()):  # one row per partition
        rows.append((r["part_"], *begin.values()))
        begin = {k: v + (r[f"{k}_"] or 0) for k, v in begin.items()}
    starts = df.sparkSession.createDataFrame(rows, "part_ int, " + ", ".join(f"{k}_ bigint" for k in values))
    before = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.join(F.broadcast(starts), "part_")
    for k, v in values.items():
        local = local.withColumn(k, F.col(f"{k}_") + F.coalesce(F.sum(v.cast("bigint")).over(before), F.lit(0)))
    return local.drop("part_", *[f"{k}_" for k in values])
