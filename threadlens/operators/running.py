"""Running totals over a whole table without a task that reads all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.sources.shared import materialise


def running_total(rows: DataFrame, order: str | Sequence[str], value: str, name: str) -> DataFrame:
    """`rows` with a column that sums `value` over all rows before a row, in the order of `order`.

    The table is range-partitioned by the order and written with the number of its partition
    and the total so far inside it. Totals by partition, one row each, give what lies before a
    partition. Rows that are equal in all columns of `order` come in any order and, as
    one range, in one task, so the columns should tell rows apart. Null values count 0.
    """
    order = [order] if isinstance(order, str) else list(order)
    worth = F.coalesce(F.col(value), F.lit(0))
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    parts = materialise(parts.withColumn("_upto", F.sum(worth).over(inside)), "running")
    sums = parts.groupBy("_part").agg(F.sum(worth).alias("_own"))
    # One row per partition of the table.
    before = F.sum("_own").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    bases = sums.select(F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_base"))
    total = F.col("_base") + F.col("_upto") - worth
    return parts.join(bases, F.col("_part") == F.col("_of")).select(*rows.columns, total.alias(name))
