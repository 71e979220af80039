"""Which line ranges of a file stand, and which lines they cover, however many ranges a file has.

Ranges are taken by first line, the wider of several first; one stands if it begins behind the end of the last that stands.
That is a chain through the whole file, so it is followed in blocks.  Rows are cut into blocks of the sort order.  Within
a block every range knows the next one that does not overlap it, and so where a chain that enters
the block with it leaves the block (from the last range back).  Summaries of a block, one for each stretch of entries that leave
alike, say for any reach with which a file comes in how far it reaches behind the block.  A file's summaries are followed
in order, one number at a time, which gives every block its own start; then blocks are gone through again, each
on its own.  No task holds a file's ranges and no step costs more than their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thriftline.session import written

_ROW_BITS = 33
#: Lines under one mask.
_MASK = 64


def leaves(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How far a chain reaches behind these ranges (in order) if it enters with each of them."""
    following = np.searchsorted(starts, ends, side="right").tolist()
    found = ends.tolist()
    for i in range(len(found) - 1, -1, -1):
        if following[i] < len(found):
            found[i] = found[following[i]]
    return np.array(found, dtype=np.int64)


def _segments(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(keys)]
    yield from zip(bounds, bounds[1:])


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(file_id, block, last_start, reach)`` of the segments of one task's blocks; rows come in order.

    Held are the numbers of the one file and block that the rows so far end with.
    """
    columns = ["file_id", "block", "last_start", "reach"]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    open_key = None

    def summed() -> list[tuple]:
        starts, ends = (np.concatenate(parts) for parts in zip(*held))
        reach = leaves(starts, ends)
        last = np.flatnonzero(np.append(reach[1:] != reach[:-1], True))
        return [(*open_key, start, far) for start, far in zip(starts[last].tolist(), reach[last].tolist())]

    for frame in frames:
        if not len(frame):
            continue
        found = []
        new = (frame["file_id"] != frame["file_id"].shift()) | (frame["block"] != frame["block"].shift())
        names, blocks, starts, ends = (frame[c].to_numpy() for c in ("file_id", "block", "start", "end"))
        for a, b in _segments(new.cumsum().to_numpy()):
            key = (names[a], int(blocks[a]))
            if key != open_key:
                if held:
                    found += summed()
                held, open_key = [], key
            # A copy, as a view would keep the whole frame.
            held.append((starts[a:b].copy(), ends[a:b].copy()))
        yield pd.DataFrame(found, columns=columns)
    if held:
        yield pd.DataFrame(summed(), columns=columns)


def _followed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(file_id, block, reach)``: the reach a file comes into its second and later blocks with."""
    file_id = block = reach = entered = None
    for frame in frames:
        found = []
        for name, number, last_start, leaving in frame.itertuples(index=False):
            if name != file_id:
                file_id, block, reach, entered = name, number, None, False
            elif number != block:
                block, entered = number, False
                found.append((name, number, reach))
            if not entered and (reach is None or last_start > reach):
                reach, entered = leaving, True
        yield pd.DataFrame(found, columns=["file_id", "block", "reach"])


def _flagged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(at, inner)`` of rows in order; ``came`` is the reach their file comes into their block with."""
    file_id = block = reach = None
    for frame in frames:
        inner = []
        columns = (frame[c].tolist() for c in ("file_id", "block", "start", "end", "came"))
        for name, number, start, end, came in zip(*columns):
            if (name, number) != (file_id, block):
                file_id, block, reach = name, number, None if pd.isna(came) else int(came)
            overlaps = reach is not None and start <= reach
            inner.append(overlaps)
            if not overlaps:
                reach = end
        yield pd.DataFrame({"at": frame["at"], "inner": inner})


def overlap_flags(ranges: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """Add ``inner`` to ``ranges(keys, start_line, end_line, ...)``: the range overlaps one that stands.

    Ranges are unique per file; those without both lines stand.
    """
    marked = written(ranges.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    usable = marked.where(F.col("start_line").isNotNull() & F.col("end_line").isNotNull())
    # A file's id is its key as text, so that NULL is a value and Python can compare it.
    narrow = usable.select(
        F.to_json(F.struct(*keys)).alias("file_id"), F.col("start_line").cast("bigint").alias("start"), F.col("end_line").cast("bigint").alias("end"), "_id"
    )
    order = ["file_id", "start", F.col("end").desc(), "_id"]
    dealt = narrow.repartitionByRange(blocks, *order) if blocks else narrow.repartitionByRange(*order)
    placed = written(dealt.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    blocked = placed.withColumn("block", F.shiftright("at", _ROW_BITS))

    def in_blocks(df: DataFrame, *columns: str) -> DataFrame:
        return df.repartition("block").sortWithinPartitions("at").select(*columns)

    rows = ["file_id", "block", "start", "end"]
    summaries = in_blocks(blocked, *rows).mapInPandas(_summaries, "file_id string, block bigint, last_start bigint, reach bigint")
    followed = (
        summaries.repartition("file_id").sortWithinPartitions("file_id", "block", "last_start")
        .mapInPandas(_followed, "file_id string, block bigint, reach bigint")
    )
    came = written(followed.select("file_id", "block", F.col("reach").alias("came")), "came")
    entered = blocked.join(came, ["file_id", "block"], "left")
    flags = in_blocks(entered, *rows, "came", "at").mapInPandas(_flagged, "at bigint, inner boolean")
    found = placed.select("_id", "at").join(flags, "at").select("_id", "inner")
    return marked.join(found, "_id", "left").select(*ranges.columns, F.coalesce("inner", F.lit(False)).alias("inner"))


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def stands_in_row(starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Which ranges of one row stand, for rows that hold a file's ranges in order anyway; those without both lines do."""
    found = []
    for first, last in zip(starts.to_pylist(), ends.to_pylist()):
        reach, flags = None, []
        for start, end in zip(first, last):
            usable = start is not None and end is not None
            stands = not usable or reach is None or start > reach
            flags.append(stands)
            if usable and stands:
                reach = end
        found.append(flags)
    return pa.array(found, pa.list_(pa.bool_()))


def covered_lines(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, bin, mask)``: of every 64 lines that ranges touch, a bit for each line that one covers.

    Ranges of any number that cover the same lines meet in one row, before the shuffle already.
    """
    first, last = F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint")
    bins = F.sequence(F.floor(first / _MASK), F.floor(last / _MASK))
    spread = ranges.where(first <= last).select(*keys, first.alias("_a"), last.alias("_b"), F.explode(bins).alias("bin"))
    low = F.greatest(F.col("_a") - F.col("bin") * _MASK, F.lit(0)).cast("int")
    high = F.least(F.col("_b") - F.col("bin") * _MASK, F.lit(_MASK - 1)).cast("int")
    # All bits up to the highest one and from the lowest one on.
    upto = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(_MASK - 1) - high)
    mask = upto.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), low))
    return spread.select(*keys, "bin", mask.alias("_mask")).groupBy(*keys, "bin").agg(F.bit_or("_mask").alias("mask"))


def is_covered(line: Column, mask: Column) -> Column:
    return F.getbit(mask, F.pmod(line.cast("bigint"), F.lit(_MASK)).cast("int")) == 1
