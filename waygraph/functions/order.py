"""Running totals over a whole table's order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.loop import materialise


def running_total(df: DataFrame, order: str, value: Column, name: str = "before") -> DataFrame:
    """Adds the sum of `value` over all rows that come before in `order`, whose values are distinct and not null.

    Rows are dealt by ranges of the order; the ranges' totals, one row each, are
    added up in one task, the rows of a range in its own.
    """
    dealt = materialise(df.repartitionByRange(order).withColumns({"_range": F.spark_partition_id(), "_value": value}), "ranges")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(F.sum("_value").alias("n")).select("_range", F.sum("n").over(before.orderBy("_range")).alias("_earlier"))
    inside = F.sum("_value").over(before.partitionBy("_range").orderBy(order))
    zero = F.lit(0).cast("long")
    whole = dealt.join(F.broadcast(totals), "_range")  # a row for each range
    return whole.withColumn(name, F.coalesce("_earlier", zero) + F.coalesce(inside, zero)).drop("_range", "_value", "_earlier")


def next_in_order(df: DataFrame, group: list[str], by: str, name: str = "after") -> DataFrame:
    """Adds the next larger value of `by` within the group, null for its last; (group, by) are distinct and not null.

    Rows are dealt by ranges of (group, by), so a large group is spread over
    tasks; the last row of a range gets the first value of the next range.
    """
    key = F.struct(*group, by)
    dealt = materialise(df.repartitionByRange(*group, by).withColumn("_range", F.spark_partition_id()), "ranges")
    firsts = dealt.groupBy("_range").agg(F.min(key).alias("_first"))
    # ranges without rows are absent, so numbers may skip
    firsts = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_next"))
    inside = F.lead(key).over(Window.partitionBy("_range").orderBy(*group, by))
    both = dealt.withColumn("_inside", inside).join(F.broadcast(firsts), "_range")  # a row for each range
    then = F.coalesce("_inside", "_next")
    same = F.lit(True)
    for g in group:
        same = same & (then[g] == F.col(g))
    return both.withColumn(name, F.when(same, then[by])).drop("_range", "_inside", "_next")
