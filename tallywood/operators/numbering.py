"""Row numbers by a total order in two passes, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import settle

_MASK = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[str], name: str = "number", group: str | None = None) -> DataFrame:
    """Adds a number from 1 on, by ``order`` within each group (a null group is one too) or over all rows.

    Rows are dealt to ranges of (group, order) and sorted there; each range's number of rows gives where its
    numbers begin, and a group's numbers begin where its first row stands. Only the counts of the ranges, a row for each,
    come together. Ties take any order among themselves. The rows are written once in between.
    """
    keys = [group, *order] if group else order
    dealt = rows.repartitionByRange(*[F.asc(k) for k in keys]).sortWithinPartitions(*keys)
    held = settle(dealt.withColumns({"part__": F.spark_partition_id(), "at__": F.monotonically_increasing_id().bitwiseAND(_MASK)}))
    sizes = held.groupBy("part__").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    every = held.join(F.broadcast(sizes.select("part__", before.alias("before__"))), "part__").withColumn(name, F.col("before__") + F.col("at__") + 1)
    if group:
        first = every.groupBy(F.col(group).alias("group__")).agg(F.min(name).alias("first__"))
        every = every.join(first, F.col(group).eqNullSafe(F.col("group__"))).withColumn(name, F.col(name) - F.col("first__") + 1).drop("group__", "first__")
    return every.drop("part__", "at__", "before__")
