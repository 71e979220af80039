"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are quantised to integers and ordered so that alike ones are near each other (by the signs of their leading
components).  Every ``BLOCK`` vectors in that order are a block with a forward index (its matrix) and, for each
component, the largest and smallest value it holds; ``SHARD`` vectors are a shard, the unit that tasks work on.  The bound of a
query on a block is the sum over components of the larger product with the block's two extremes: no
vector in it scores more.

* Home pass: each shard answers the queries it holds from its own blocks, which gives each query ``k`` candidates
  and a threshold that the final k-th score cannot be under.
* Shards whose bound for a query is under its threshold are out before any vector is sent.
* Cells: the queries of one shard that are left meet the blocks of another.  A query takes its blocks by
  falling bounds and stops when a bound falls below its k-th score so far.
* The candidates of all cells, at most ``k`` a query and cell, are ranked.

A bound equal to the k-th score does not stop a query, so ties are settled by the smaller id over all
vectors.  Packs of queries meet packs of shards by key; neither side is broadcast.

Defined results: vectors that are NULL or hold NULL or non-finite components, and rows without an id, take no
part; vectors of different lengths are compared as if padded with zeros; repeated ids are rows of
their own, each a candidate of the other; no vectors give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thriftline.operators.numbering import numbered
from thriftline.session import written

K = 20
SCALE = 64
BLOCK = 64
SHARD = 4096
QUERY_STEP = 20
#: Shards whose summaries make one pack.
PACK = 512
_CODE_BITS = 20
_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v, code)`` of the vectors that take part."""
    raw = F.col("embedding")
    usable = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(raw, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    taken = vectors.where(F.col("vec_id").isNotNull() & raw.isNotNull() & usable)
    code: Column = F.lit(0)
    for i in range(_CODE_BITS):
        code = code * 2 + F.coalesce((F.get("v", F.lit(i)) >= 0).cast("int"), F.lit(0))
    return taken.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v")).withColumn("code", code)


def _small(matrix: np.ndarray) -> np.ndarray:
    """In the narrowest integers that hold it."""
    for kind in ("<i1", "<i2", "<i4"):
        if not matrix.size or (matrix.min() >= np.iinfo(kind).min and matrix.max() <= np.iinfo(kind).max):
            return matrix.astype(kind)
    return matrix


def _pack(matrix: np.ndarray) -> dict:
    small = _small(matrix)
    return {"kind": small.dtype.str, "width": matrix.shape[1], "data": small.tobytes()}


def _unpack(cell: dict) -> np.ndarray:
    """As floats where products are exact in them, else as 64-bit integers."""
    found = np.frombuffer(cell["data"], dtype=cell["kind"]).reshape(-1, cell["width"])
    return found.astype(np.int64 if cell["kind"] in ("<i4", "<i8") else np.float64)


_MATRIX = "struct<kind:string,width:int,data:binary>"


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` over the components both have, as integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if a.dtype != b.dtype:
        a, b = a.astype(np.int64), b.astype(np.int64)
    return (a @ b.T).astype(np.int64)


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds as floats: exact for small components, rounded up where products might not be."""
    width = min(queries.shape[1], high.shape[1])
    q, high, low = (m[:, :width].astype(np.float64) for m in (queries, high, low))
    # Components past the narrower width count as zero on one side, so they add nothing.
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    if queries.dtype == np.int64:
        size = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T
        bound = bound + 1e-9 * size
    return bound


def _extremes(matrix: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest of each component in each block of rows."""
    at = np.arange(0, len(matrix), block)
    return np.maximum.reduceat(matrix, at, axis=0), np.minimum.reduceat(matrix, at, axis=0)


class Best:
    """The ``k`` best of each query so far; ties go to the smaller id, then the smaller position."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(queries, _NONE) if floor is None else floor.copy()
        self.query = self.id = self.place = self.score = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, places: np.ndarray, score: np.ndarray) -> None:
        touched = np.isin(self.query, query)
        q = np.concatenate([self.query[touched], query])
        i = np.concatenate([self.id[touched], ids])
        p = np.concatenate([self.place[touched], places])
        s = np.concatenate([self.score[touched], score])
        order = np.lexsort((p, i, -s, q))
        q, i, p, s = q[order], i[order], p[order], s[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.query = np.concatenate([self.query[~touched], q[keep]])
        self.id = np.concatenate([self.id[~touched], i[keep]])
        self.place = np.concatenate([self.place[~touched], p[keep]])
        self.score = np.concatenate([self.score[~touched], s[keep]])


def search(
    queries: np.ndarray, own: np.ndarray, matrix: np.ndarray, ids: np.ndarray, places: np.ndarray, best: Best, block: int
) -> int:
    """Take each query through its blocks by falling bounds; the number of (query, block) pairs scored."""
    high, low = _extremes(matrix, block)
    bounds = _bounds(queries.astype(np.int64) if matrix.dtype == np.int64 else queries, high, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    active = np.arange(len(queries))
    scored = 0
    for turn in range(bounds.shape[1]):
        at = order[active, turn]
        active = active[bounds[active, at] >= best.floor[active]]
        if not len(active):
            break
        at = order[active, turn]
        scored += len(active)
        by_block = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[by_block])) + 1
        found = []
        for group in np.split(by_block, cuts):
            members, start = active[group], int(at[group[0]]) * block
            rows = slice(start, start + block)
            score = _multiply(queries[members], matrix[rows])
            hit = (score >= best.floor[members][:, None]) & (places[rows][None, :] != own[members][:, None])
            q, d = np.nonzero(hit)
            found.append((members[q], ids[rows][d], places[rows][d], score[q, d]))
        best.add(*(np.concatenate(part) for part in zip(*found, strict=True)))
    return scored


_SHARD = f"shard bigint, ids binary, places binary, matrix {_MATRIX}"
_PACKED = f"qids binary, qplaces binary, queries {_MATRIX}, floors binary"
_FOUND = "query_id bigint, query_place bigint, vec_id bigint, place bigint, score bigint"


def _longs(values: np.ndarray) -> bytes:
    return values.astype("<i8").tobytes()


def _read(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            members = sorted(row["members"], key=lambda m: m["position"])
            width = max(len(m["v"]) for m in members)
            matrix = np.zeros((len(members), width), dtype=np.int64)
            for i, m in enumerate(members):
                matrix[i, : len(m["v"])] = m["v"]
            ids = np.array([m["vec_id"] for m in members], dtype=np.int64)
            places = np.array([m["position"] for m in members], dtype=np.int64)
            yield pa.RecordBatch.from_pylist(
                [{"shard": row["shard"], "ids": _longs(ids), "places": _longs(places), "matrix": _pack(matrix)}],
                schema=_arrow(_SHARD),
            )


def _arrow(ddl: str) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "binary": pa.binary(),
        _MATRIX: pa.struct([("kind", pa.string()), ("width", pa.int32()), ("data", pa.binary())]),
    }
    return pa.schema([(part.split(" ")[0], kinds[part.split(" ")[1]]) for part in ddl.split(", ")])


def _found(best: Best, qids: np.ndarray, qplaces: np.ndarray) -> dict[str, np.ndarray]:
    return {
        "query_id": qids[best.query], "query_place": qplaces[best.query],
        "vec_id": best.id, "place": best.place, "score": best.score,
    }


def _home(k: int, block: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, places, matrix = _read(row["ids"]), _read(row["places"]), _unpack(row["matrix"])
                mine = np.flatnonzero(ids % step == 0)
                if not len(mine):
                    continue
                best = Best(len(mine), k)
                search(matrix[mine], places[mine], matrix, ids, places, best, block)
                found = _found(best, ids[mine], places[mine])
                out = {
                    "shard": row["shard"], "qids": _longs(ids[mine]), "qplaces": _longs(places[mine]),
                    "queries": _pack(matrix[mine].astype(np.int64)), "floors": _longs(best.floor),
                    **{n: _longs(v) for n, v in found.items()},
                }
                schema = _arrow("shard bigint, " + _PACKED + ", " + _FOUND.replace("bigint", "binary"))
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    return run


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(f"shard bigint, high {_MATRIX}, low {_MATRIX}")
    for batch in batches:
        for row in batch.to_pylist():
            matrix = _unpack(row["matrix"]).astype(np.int64)
            high, low = _extremes(matrix, len(matrix))
            yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "high": _pack(high), "low": _pack(low)}], schema=schema)


_CELL = "shard bigint, " + _PACKED


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of a pack that another shard may still answer."""
    schema = _arrow(_CELL)
    for batch in batches:
        for row in batch.to_pylist():
            queries, floors = _unpack(row["queries"]), _read(row["floors"])
            qids, qplaces = _read(row["qids"]), _read(row["qplaces"])
            for other in row["summaries"]:
                if other["shard"] == row["shard"]:
                    continue
                high, low = (_unpack(other[n]) for n in ("high", "low"))
                wide = np.int64 in (high.dtype, low.dtype)
                bound = _bounds(queries.astype(np.int64) if wide else queries, high, low)[:, 0]
                left = np.flatnonzero(bound >= floors)
                if len(left):
                    cell = {
                        "shard": other["shard"], "qids": _longs(qids[left]), "qplaces": _longs(qplaces[left]),
                        "queries": _pack(queries[left].astype(np.int64)), "floors": _longs(floors[left]),
                    }
                    yield pa.RecordBatch.from_pylist([cell], schema=schema)


def _away(k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qids, qplaces, floors = _read(row["qids"]), _read(row["qplaces"]), _read(row["floors"])
                best = Best(len(qids), k, floors)
                ids, places, matrix = _read(row["ids"]), _read(row["places"]), _unpack(row["matrix"])
                search(_unpack(row["queries"]), qplaces, matrix, ids, places, best, block)
                if len(best.query):
                    yield pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in _found(best, qids, qplaces).items()})

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _FOUND.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pydict({n: pa.array(_read(row[n])) for n in names})


def top_k(vectors: DataFrame, k: int = K, block: int = BLOCK, shard: int = SHARD, step: int = QUERY_STEP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of the rows whose id ``step`` divides."""
    placed = numbered(quantised(vectors), [], [F.col("code"), F.col("vec_id"), F.col("v")])
    member = F.struct(F.col("position"), F.col("vec_id"), F.col("v"))
    packed = (
        placed.withColumn("position", F.col("position") - 1)
        .groupBy(F.floor(F.col("position") / shard).cast("bigint").alias("shard"))
        .agg(F.collect_list(member).alias("members"))
    )
    shards = written(packed.mapInArrow(_shards, _SHARD), "shards")
    home = written(
        shards.mapInArrow(_home(k, block, step), "shard bigint, " + _PACKED + ", " + _FOUND.replace("bigint", "binary")), "home"
    )
    summary = (
        shards.mapInArrow(_summaries, f"shard bigint, high {_MATRIX}, low {_MATRIX}")
        .groupBy(F.floor(F.col("shard") / PACK).cast("bigint").alias("_pack"))
        .agg(F.collect_list(F.struct("shard", "high", "low")).alias("summaries"))
    )
    last = shards.agg(F.max("shard")).first()[0] or 0
    packs = home.select(
        "shard", "qids", "qplaces", "queries", "floors",
        F.explode(F.sequence(F.lit(0), F.lit(math.floor(last / PACK))).cast("array<bigint>")).alias("_pack"),
    )
    cells = packs.join(summary, "_pack").drop("_pack").mapInArrow(_cells, _CELL)
    away = cells.join(shards, "shard").mapInArrow(_away(k, block), _FOUND)
    near = home.select("query_id", "query_place", "vec_id", "place", "score").mapInArrow(_unpacked, _FOUND)
    ranked = Window.partitionBy("query_place").orderBy(F.col("score").desc(), "vec_id", "place")
    return (
        near.unionByName(away)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
