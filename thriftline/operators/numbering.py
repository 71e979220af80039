"""Row numbers within groups of any size.

A window over a whole group puts it into one task.  Here rows are cut into
ranges of the sort order first and sorted within each range.  A row's place in
its range plus the sizes of the group's ranges before it is its position, so no
task holds more than one range and no window runs over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thriftline.session import written

# monotonically_increasing_id() counts the rows of a task in its lower 33 bits.
_ROW_BITS = 33


def numbered(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    position: str = "position",
    size: str | None = None,
    span: str | None = None,
) -> DataFrame:
    """Add the 1-based ``position`` of each row in its group, the group's ``size`` and the ``span``.

    A span is the number of the range a row fell into; spans follow the order too
    and are small enough for one task each.

    ``order`` has to tell all rows of a group apart.  The ranges are written out
    once: the two passes that follow see the same places even after a task is
    run again, and the pass that counts reads the group columns only.
    """
    keys = [F.col(g) for g in group]
    in_ranges = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(in_ranges.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    # As one key the group columns compare NULL as a value.
    keyed = placed.withColumns(
        {"_group": F.struct(*group) if group else F.lit(0), "_range": F.shiftright("_at", _ROW_BITS)}
    )
    sizes = keyed.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # One row per range of a group from here on.
    by_group = Window.partitionBy("_group")
    before = by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_group",
        "_range",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_n").over(by_group).alias("_size"),
    )
    extra = [F.col("_size").alias(size)] if size else []
    extra += [F.col("_range").alias(span)] if span else []
    return keyed.join(offsets, ["_group", "_range"]).select(
        *df.columns, (F.col("_at") + F.col("_shift")).alias(position), *extra
    )
