"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits.  For a radius ``r`` every bit position gets a non-zero vector
of ``r + 1`` bits, and every non-zero vector ``v`` of that length is a table whose mask
holds the positions with an odd inner product with ``v``.  The at most ``r`` positions in
which two fingerprints differ span at most ``r`` dimensions, so some ``v`` is orthogonal to
all of them: under its mask the two agree.  All pairs within the radius meet in a table,
always, not just probably; with ``r = 4`` there are 31 tables of about 33 bits each.

Equal fingerprints are one node.  Buckets of a table are linked by breadth-first search
over Hamming distances, which yields one link a member at most, never all pairs.  A bucket
of over ``BUCKET`` nodes is split without loss: members within the radius differ in bits outside
the mask only, so each meets the other at a point that flips at most half the radius of
those bits from either; nodes that meet at such a point are within the radius for sure.

Defined results: a NULL or empty text has fingerprint zero and is linked like any other;
texts of fewer words than a shingle are hashed whole; a component's id is its smallest
``doc_id`` and NULL only if all its ids are; repeated rows each get a row; no documents
give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from thriftline.llm import components, corpus
from thriftline.session import written

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
BUCKET = 4096
_BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of each shingle, as a signed 64-bit number."""
    found = corpus.words(text)
    if not found:
        return 0
    whole = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    width = min(width, len(found))
    starts, stops = (ends - lengths)[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), _BLOCK):
        cuts = map(slice, starts[at : at + _BLOCK], stops[at : at + _BLOCK])
        hashes = b"".join(map(xxhash.xxh64_digest, map(whole.__getitem__, cuts), itertools.repeat(SEED)))
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every document."""
    return corpus.each_text(
        docs,
        [F.col("doc_id").cast("bigint").alias("doc_id")],
        lambda texts: {"fp": pa.array([fingerprint(t, width) for t in texts], pa.int64())},
        "doc_id bigint, fp bigint",
    )


def masks(radius: int = RADIUS) -> list[int]:
    """One mask for each table of the covering family, as unsigned 64-bit numbers."""
    vectors = [i % ((1 << radius + 1) - 1) + 1 for i in range(BITS)]
    return [
        sum(1 << i for i, phi in enumerate(vectors) if bin(phi & v).count("1") % 2)
        for v in range(1, 1 << (radius + 1))
    ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def buckets(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(table, key, fp)``: every node's place in every table."""
    places = [
        F.struct(F.lit(t).cast("tinyint").alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(masks(radius))
    ]
    return nodes.select("fp", F.explode(F.array(*places)).alias("_p")).select("_p.table", "_p.key", "fp")


def stars(members: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links from each reachable member to the first member of its group, within one bucket."""
    left = np.unique(members)
    a: list[int] = []
    b: list[int] = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        for node in queue:
            near = np.bitwise_count(np.bitwise_xor(left, node).view(np.uint64)) <= radius
            if near.any():
                reached = left[near]
                left = left[~near]
                a.extend(reached.tolist())
                b.extend([int(root)] * len(reached))
                queue.extend(reached)
                if not len(left):
                    break
    return a, b


def _linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.values.to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_pylist()
            a: list[int] = []
            b: list[int] = []
            for start, stop in itertools.pairwise(offsets):
                more_a, more_b = stars(values[start:stop], radius)
                a += more_a
                b += more_b
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _around(radius: int) -> Column:
    """Points that flip at most half of ``radius`` bits outside the table's mask."""
    flips = []
    for m in masks(radius):
        free = [1 << i for i in range(BITS) if not m >> i & 1]
        few = [sum(c) for k in range(radius // 2 + 1) for c in itertools.combinations(free, k)]
        flips.append(F.array(*[F.lit(_signed(x)) for x in few]))
    return F.transform(F.element_at(F.array(*flips), F.col("table").cast("int") + 1), lambda x: F.col("fp").bitwiseXOR(x))


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` links inside buckets of at most ``bucket`` nodes, and ``(table, fp)`` of the members of larger ones.

    Together with :func:`split_links` of the latter they connect exactly the nodes that
    distances within ``radius`` connect.
    """
    placed = buckets(nodes, radius)
    sizes = placed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Spark sizes both sides without the rows that explode adds and would broadcast them, which it does not take back.
    sized = placed.join(sizes.hint("merge"), ["table", "key"])
    small = (
        sized.where(F.col("_n") <= bucket)
        .groupBy("table", "key")
        .agg(F.collect_list("fp").alias("members"))
        .select("members")
        .mapInArrow(_linked(radius), "a bigint, b bigint")
    )
    return small, sized.where(F.col("_n") > bucket).select("table", "fp")


def split_links(crowded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links of the crowded buckets' members: those that share a point around them, at most a ball's worth."""
    return (
        crowded.select("table", "fp", F.explode(_around(radius)).alias("_point"))
        .groupBy("table", "_point")
        .agg(F.collect_set("fp").alias("members"))
        .where(F.size("members") > 1)
        .select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id, root)`` of every document; ``root`` is the least fingerprint of its group."""
    prints = written(fingerprints(docs, width), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    near, crowded = links(nodes, radius, bucket)
    found = near
    if not crowded.isEmpty():
        found = near.unionByName(split_links(crowded, radius))
    linked = components.roots(found)
    placed = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = written(placed.join(least, "root").select("fp", "component_id", "root"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "root")


def first_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Of several rows of the group with that id one stays; of a group without any id, one.
    """
    found = written(near_duplicates(docs, radius), "near")
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    often = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if often.isEmpty() and found.where(F.col("doc_id").isNull()).isEmpty():
        return docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    # An id that does not name one row is not enough to find a group's row: those rows are found by their text.
    once = docs.join(first.join(often, "doc_id", "left_anti"), "doc_id", "left_semi").select(*docs.columns)
    odd = docs.where(F.col("doc_id").isNull()).unionByName(docs.join(often, "doc_id", "left_semi").select(*docs.columns))
    keyed = odd.select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), _printed(corpus.text_bytes()).alias("_fp")
    )
    classes = found.select(F.col("fp").alias("_fp"), "component_id", "root").distinct()
    mine = keyed.join(classes, "_fp").where(F.col("_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
    return once.unionByName(mine.select("_row.*"))


@F.pandas_udf(LongType())
def _printed(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")
