"""Sums over all rows before a row, within groups of any size.

As with row numbers no window runs over a group: rows are cut into ranges of the sort order, the sums of ranges are
added up (a row for each range), and within a range a window over that range alone does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thriftline.session import written

_ROW_BITS = 33


def running_total(df: DataFrame, group: list[str], order: list[Column], weight: Column, before: str = "before", total: str = "total") -> DataFrame:
    """Add what the rows before weigh and what the whole group weighs, as bigints.

    ``order`` has to tell all rows of a group apart.  Rows are written once in order; give narrow ones.
    """
    keys = [F.col(g) for g in group]
    weighed = df.withColumn("_weight", weight.cast("bigint"))
    in_ranges = weighed.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(in_ranges.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    keyed = placed.withColumns(
        {"_group": F.struct(*group) if group else F.struct(F.lit(0)), "_range": F.shiftright("_at", _ROW_BITS)}
    )
    sums = keyed.groupBy("_group", "_range").agg(F.sum("_weight").alias("_sum"))
    by_group = Window.partitionBy("_group")
    ranges_before = by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_group", "_range", F.coalesce(F.sum("_sum").over(ranges_before), F.lit(0)).alias("_shift"), F.sum("_sum").over(by_group).alias(total)
    )
    own = Window.partitionBy("_group", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    within = keyed.withColumn("_within", F.coalesce(F.sum("_weight").over(own), F.lit(0)))
    return within.join(offsets, ["_group", "_range"]).select(*df.columns, (F.col("_within") + F.col("_shift")).alias(before), total)
