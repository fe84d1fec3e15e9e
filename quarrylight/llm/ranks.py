"""Row numbers within keys that may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least parts that each key's rows are spread over, and rows of all keys from which there are more.
SALTS, PART_ROWS = 64, 1 << 20


def ranked(df: DataFrame, keys: list[str], order: Column, salts: int | None = None) -> DataFrame:
    """``df`` with ``rank``, from 0 without gaps within ``keys``, in an order set by ``order``, a well-spread bigint.

    A key's rows are numbered in ``salts`` parts; the parts' sizes, summed, give where each begins. Unless given, their
    number is such that a part stays under about ``PART_ROWS`` rows, whatever a key's share.
    """
    salts = max(SALTS, df.count() // PART_ROWS) if salts is None else salts
    rows = df.withColumn("order_", order).withColumn("salt_", F.pmod("order_", F.lit(salts)).cast("int"))
    part = [*keys, "salt_"]
    sizes = rows.groupBy(*part).agg(F.count("*").alias("n_"))
    before = Window.partitionBy(*keys).orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*part, F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    within = F.row_number().over(Window.partitionBy(*part).orderBy("order_")) - 1
    return rows.withColumn("within_", within).join(starts, part).withColumn("rank", F.col("start_") + F.col("within_")).drop("order_", "salt_", "within_", "start_")
