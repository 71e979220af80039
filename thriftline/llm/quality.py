"""Quality rules: fixed limits first, then robust multivariate outliers per language and source.

Each text gives five counts (``FIELDS``).  Texts within the base limits become vectors of four transformed
statistics in fixed point (1/1024): log of the mean word length, and logs of symbols, repeated lines and
repeated words per 100 words; ``PRIOR`` average words are added to each text so that short ones are not judged by noise.

For every language and source, every language, and all documents together, a minimum-covariance-determinant
estimate is made over all of the group's vectors, by concentration steps: the share ``KEPT`` of
vectors that are nearest to the present estimate give the next one.  Two starts (medians with median
deviations, and plain moments) are concentrated side by side; the one with the smaller determinant is
reweighted once and used.  Each scatter gets ``RESOLUTION`` squared on its diagonal, so a group of copies does not
make everything else an outlier.  A vector is rejected when its squared Mahalanobis distance is beyond the
``TAIL`` point of a chi-squared law with four degrees of freedom.  Groups of under ``LEAST`` vectors are judged
by their language's estimate, then by that of all documents; where that has too few as well, nothing is rejected.

No group is ever in one place: medians come from counts of fixed-point values, nearest shares from counts of
distance bins, moments from sums of integers, all combined before the shuffle.  Sums are exact, so the
verdicts do not depend on how rows are split.

Defined results: a NULL or empty text has zero counts and fails the base limits; a NULL language or source is a
value of its own; repeated rows count each; no documents give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.llm import corpus
from thriftline.session import written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
WINDOW = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20
PRIOR = 20
PRIOR_LENGTH = 5
UNIT = 1024
KEPT = 0.75
STEPS = 6
LEAST = 100
TAIL = 1e-5
REWEIGHTED = 0.025
#: Differences in a transformed statistic that mean nothing: word length, symbols, repeated lines, repeated words.
RESOLUTION = (0.05, 0.5, 0.5, 0.75)
_BINS = 32
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(found: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more, the first included.

    Windows are compared by hash first and byte by byte where hashes agree, so memory is a few numbers a word.
    """
    if len(found) <= window:
        return 0
    whole = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[: len(found) - window + 1], ends[window - 1 :]
    hashes = np.fromiter(map(hash, map(whole.__getitem__, map(slice, starts.tolist(), stops.tolist()))), np.int64, len(starts))
    ordered = np.sort(hashes)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    places: dict[bytes, list[int]] = {}
    for at in np.flatnonzero(np.isin(hashes, again)).tolist():
        places.setdefault(whole[starts[at] : stops[at]], []).append(at)
    covered = np.zeros(len(found) + 1, dtype=np.int64)
    for where in places.values():
        if len(where) > 1:
            np.add.at(covered, where, 1)
            np.add.at(covered, np.asarray(where) + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """``FIELDS`` of one text."""
    shown = text.decode("utf-8", "replace")
    found = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()] if found else []
    return (
        len(found),
        len(shown) - sum(map(shown.count, BLANKS)),
        sum(map(shown.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(found),
    )


def _measured(texts: Iterable[bytes]) -> dict[str, list]:
    rows = [measure(t) for t in texts]
    return {name: [r[i] for r in rows] for i, name in enumerate(FIELDS)}


def tail_point(share: float, freedom: int) -> float:
    """Where a chi-squared law of an even number of degrees of freedom leaves ``share`` above."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid, freedom) > share else (low, mid)
    return high


def above(point: float, freedom: int) -> float:
    """Share of a chi-squared law of an even number of degrees of freedom above ``point``."""
    half = point / 2
    return math.exp(-half) * sum(half**k / math.factorial(k) for k in range(freedom // 2))


def consistency(share: float, freedom: int) -> float:
    """Factor that makes the scatter of the nearest ``share`` unbiased for normal vectors."""
    return share / (1 - above(tail_point(1 - share, freedom), freedom + 2))


P = len(RESOLUTION)
_X = [f"x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _vectors(counted: DataFrame) -> DataFrame:
    words = F.col("n_words") + PRIOR
    per_100 = lambda c: F.log1p(F.col(c) * 100 / words)
    stats = [
        F.log((F.col("word_chars") + PRIOR * PRIOR_LENGTH) / words),
        per_100("n_symbols"), per_100("n_dup_lines"), per_100("n_repeat_words"),
    ]
    return counted.withColumns({n: F.round(x * UNIT).cast("bigint") for n, x in zip(_X, stats, strict=True)})


def _key(*names: str) -> Column:
    """One text for a group; absent members stand for NULL."""
    return F.to_json(F.struct(F.lit(len(names)).alias("level"), *names))


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x`` from ``mean`` under the inverse scatter ``inverse``."""
    off = [F.col(n) / UNIT - F.col("mean")[i] for i, n in enumerate(_X)]
    return sum(
        (off[i] * off[j] * F.col("inverse")[k] * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0)
    )


def _estimate(n: float, sums: np.ndarray, products: np.ndarray, factor: float) -> tuple[list[float], list[float], float]:
    mean = sums / n
    scatter = np.zeros((P, P))
    for k, (i, j) in enumerate(_PAIRS):
        scatter[i, j] = scatter[j, i] = products[k] / n - mean[i] * mean[j]
    return _solved(mean, factor * scatter)


def _solved(mean: np.ndarray, scatter: np.ndarray) -> tuple[list[float], list[float], float]:
    scatter = scatter + np.diag(np.square(RESOLUTION))
    inverse = np.linalg.inv(scatter)
    return mean.tolist(), [float(inverse[i, j]) for i, j in _PAIRS], float(np.linalg.slogdet(scatter)[1])


_ESTIMATES = "key string, start int, size bigint, mean array<double>, inverse array<double>, logdet double"


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exact first and second moments, of ``w`` rows each."""
    weight = F.col("w")
    firsts = [F.sum(weight * F.col(n)).alias(f"s{i}") for i, n in enumerate(_X)]
    seconds = [F.sum(weight * F.col(_X[i]) * F.col(_X[j])).alias(f"p{k}") for k, (i, j) in enumerate(_PAIRS)]
    return rows.groupBy(*keys).agg(F.sum(weight).alias("n"), *firsts, *seconds)


def _estimated(moments: DataFrame, factor: float) -> DataFrame:
    """Moments to estimates, row by row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sums = f[[f"s{i}" for i in range(P)]].to_numpy(dtype=float) / UNIT
            products = f[[f"p{k}" for k in range(len(_PAIRS))]].to_numpy(dtype=float) / UNIT**2
            made = [_estimate(n, a, b, factor) for n, a, b in zip(f["n"].astype(float), sums, products, strict=True)]
            out = f[["key", "start", "size"]].copy()
            out["mean"], out["inverse"], out["logdet"] = ([m[i] for m in made] for i in range(3))
            yield out

    return moments.mapInPandas(run, _ESTIMATES)


def _starts(rows: DataFrame) -> DataFrame:
    """Medians with median deviations (start 0) and plain moments (start 1) of every group."""
    middle = written(
        rows.groupBy("key").agg(
            F.sum("w").alias("size"), *[F.percentile(F.col(n), 0.5, F.col("w")).alias(f"m{i}") for i, n in enumerate(_X)]
        ),
        "medians",
    )
    spread = (
        rows.join(middle, "key")
        .groupBy("key", "size", *[f"m{i}" for i in range(P)])
        .agg(*[F.percentile(F.abs(F.col(n) - F.col(f"m{i}")), 0.5, F.col("w")).alias(f"d{i}") for i, n in enumerate(_X)])
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            middles = f[[f"m{i}" for i in range(P)]].to_numpy(dtype=float) / UNIT
            deviations = 1.4826 * f[[f"d{i}" for i in range(P)]].to_numpy(dtype=float) / UNIT
            made = [_solved(m, np.diag(d * d)) for m, d in zip(middles, deviations, strict=True)]
            out = f[["key", "size"]].copy()
            out.insert(1, "start", np.zeros(len(f), dtype=np.int32))
            out["mean"], out["inverse"], out["logdet"] = ([m[i] for m in made] for i in range(3))
            yield out

    plain = _sums(rows, ["key"]).withColumns({"start": F.lit(1), "size": F.col("n")})
    return spread.mapInPandas(run, _ESTIMATES).unionByName(_estimated(plain, 1.0))


def estimates(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """``(key, size, mean, inverse)`` of every group of ``(key, x0.., w)`` rows, ``w`` vectors alike each."""
    now = written(_starts(vectors), "estimates")
    factor = consistency(KEPT, P)
    for _ in range(steps):
        # Distance bins are logarithmic; the bin that completes the share is taken whole.
        placed = vectors.join(now, "key").withColumn("_bin", F.floor(F.log2(_distance() + 1e-6) * _BINS))
        limit = written(
            placed.groupBy("key", "start").agg(F.percentile(F.col("_bin"), KEPT, F.col("w")).alias("_limit")), "limits"
        )
        near = placed.join(limit, ["key", "start"]).where(F.col("_bin") <= F.ceil("_limit"))
        now = written(_estimated(_sums(near, ["key", "start", "size"]), factor), "estimates")
    best = now.groupBy("key").agg(F.min_by(F.struct("start", "size", "mean", "inverse"), F.struct("logdet", "start")).alias("_b"))
    raw = written(best.select("key", "_b.*"), "estimates")
    inside = vectors.join(raw, "key").where(_distance() <= tail_point(REWEIGHTED, P))
    final = _estimated(_sums(inside, ["key", "start", "size"]), consistency(1 - REWEIGHTED, P))
    return written(final.select("key", "size", "mean", "inverse"), "estimates")


def judged(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Counts and verdicts of every document."""
    keep = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    schema = "doc_id bigint, lang string, source string, " + ", ".join(f"{n} bigint" for n in FIELDS)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    counted = corpus.each_text(docs, keep, _measured, schema).withColumn("base_failed", failed)
    rows = written(_vectors(counted), "quality")
    levels = F.array(_key("lang", "source"), _key("lang"), _key())
    groups = rows.where(~F.col("base_failed")).groupBy("lang", "source", *_X).agg(F.count(F.lit(1)).alias("_n"))
    vectors = written(
        groups.select(F.explode(levels).alias("key"), *_X, "_n").groupBy("key", *_X).agg(F.sum("_n").alias("w")), "vectors"
    )
    made = estimates(vectors)
    known = made.where(F.col("size") >= least).select("key", F.struct("mean", "inverse").alias("_e"))
    cells = rows.select("lang", "source").distinct()
    for name, key in (("_own", _key("lang", "source")), ("_lang", _key("lang")), ("_all", _key())):
        cells = cells.withColumn("key", key).join(known.withColumnRenamed("_e", name), "key", "left").drop("key")
    chosen = written(
        cells.select(_key("lang", "source").alias("_cell"), F.coalesce("_own", "_lang", "_all").alias("_e")).select("_cell", "_e.*"),
        "chosen",
    )
    found = rows.withColumn("_cell", _key("lang", "source")).join(chosen, "_cell").withColumn("distance", _distance())
    within = F.coalesce(F.col("distance") <= tail_point(TAIL, P), F.lit(True))
    return found.select("doc_id", *FIELDS, "base_failed", (~F.col("base_failed") & within).alias("kept"), "distance")
