from __future__ import annotations

import math
import random

import numpy as np

from thriftline.llm import topk


def brute(rows: list[tuple], k: int, step: int) -> list[tuple]:
    usable = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, q) in enumerate(usable):
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, p) for p, (j, v) in enumerate(usable) if p != at)
        out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scored[:k])]
    return sorted(out)


def clustered(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(5)]
    return [(i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)]) for i in range(n)]


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank int").repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, **how).collect())


def test_equals_brute_force(spark):
    rows = clustered(700, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # many ties
    rows += [(2000, None), (2020, [1.0, None] * 6), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12), (None, rows[0][1])]
    rows += [(2080, []), (2100, [1.0, 2.0]), (2120, [3.0e9] * 12), (20, rows[5][1]), (20, rows[5][1])]
    assert run(spark, rows, shard=128, block=16) == brute(rows, 20, 20)


def test_few_vectors(spark):
    assert run(spark, [(0, [1.0, -1.0]), (1, [0.5, 0.5])]) == [(0, 1, 1, 0)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(3, [1.0]), (5, [1.0])]) == []
    assert run(spark, []) == []


def test_bounds_prune_blocks_of_alike_vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 60, (40, 16))
    matrix = np.repeat(centres, 64, axis=0) + rng.normal(0, 2, (40 * 64, 16))
    matrix = np.floor(matrix)
    at = np.arange(0, len(matrix), 50)
    best = topk.Best(len(at), 20)
    ids = np.arange(len(matrix))
    scored = topk.search(matrix[at], at, matrix, ids, ids, best, 64)
    assert scored < 0.3 * len(at) * 40
    scores = (matrix[at] @ matrix.T).astype(int)
    for row, q in enumerate(at):
        want = sorted((-s, i) for i, s in enumerate(scores[row]) if i != q)[:20]
        mine = best.query == row
        assert sorted(zip(-best.score[mine], best.id[mine])) == want
