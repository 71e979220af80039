"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its terms, hashed into ``2 ** HASH_BITS`` slots: runs of
non-space characters in lower case (A-Z only) without surrounding punctuation, and
the beginnings of longer ones (``STEMS`` bytes), so that inflected forms share a slot.
Its score is ``sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>)`` over the slots
that the model knows, so that two terms can mean together what neither means alone.

The model is fitted on a bounded sample of labelled rows: at most about ``TRAIN_ROWS``
documents, those with the lowest hashes of their ids.  First a machine over every slot that
``MIN_DOCUMENTS`` of them have is trained for ``STEPS`` steps, because a term that says nothing
alone may say everything in a pair.  The slots with the largest factors there (``PAIRED``) and
those whose own likelihood ratio stands out (``ALONE``) make up the final machine, trained anew.

Defined results: a NULL or empty text has no terms and scores as the bias; NULL
labels are left out, of several labels of one id the highest counts, of several sampled
rows of one id one trains (the one whose slots come first); repeated rows are scored each; without any usable label every score is 0.25 (the smoothed rate of
nothing).  A NULL id is never held out and never trains.
"""

from __future__ import annotations

import io
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.llm import corpus

TRAIN_ROWS = 16_000
HASH_BITS = 20
MIN_DOCUMENTS = 4
FACTORS = 8
STEMS = (4, 5, 6, 7, 8)
ALONE = 1024
PAIRED = 256
STEPS = 900
EPOCHS = 24
THRESHOLD = 0.5


class Shrink(NamedTuple):
    """How a descent steps and what it holds near zero: L2 on weights and factors, and a weight whose gradient over
    all rows stands less than ``errors`` standard errors off (in Adam's units, a batch's share of that)."""

    batch: int
    rate: float
    weights: float
    factors: float
    errors: float


#: Over all slots, to see which of them meet others in a way that tells; then over the known ones.
SCREEN = Shrink(batch=128, rate=0.02, weights=0.0, factors=1e-2, errors=3.0)
FINAL = Shrink(batch=256, rate=0.01, weights=1e-3, factors=1e-3, errors=0.0)
_EDGES = b".,;:!?\"'()[]{}<>*_-|#"


def word_slots(word: bytes) -> tuple[int, ...]:
    """Hash slots of a lower-cased word and its stems; none when nothing but punctuation is left."""
    bare = word.strip(_EDGES)
    if not bare:
        return ()
    mask = (1 << HASH_BITS) - 1
    return zlib.crc32(bare) & mask, *(zlib.crc32(b"^" + bare[:k]) & mask for k in STEMS if len(bare) > k)


def document_slots(text: bytes) -> np.ndarray:
    found = {s for w in set(corpus.words(text)) for s in word_slots(w)}
    return np.fromiter(sorted(found), dtype=np.int32, count=len(found))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: the CRC of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sampled(doc_id: str, share: float) -> Column:
    """The lowest ``share`` of the ids' hashes, the same rows on either side of a join."""
    return F.pmod(F.xxhash64(doc_id, F.lit("toxicity")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(_order, toxic, slots)`` of the sampled labelled documents outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    count = usable.count()
    share = min(1.0, rows / max(count, 1))
    marks = (
        usable.where(_sampled("doc_id", share))
        .groupBy(F.col("doc_id").alias("_label_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    near = docs.where(~held_out() & _sampled("doc_id", share)).select("doc_id", "text")
    slots = corpus.each_text(
        near,
        [F.col("doc_id")],
        lambda texts: {"slots": [document_slots(t).tobytes() for t in texts]},
        "doc_id bigint, slots binary",
    )
    single = slots.groupBy("doc_id").agg(F.min("slots").alias("slots"))
    return single.join(marks, F.col("doc_id") == F.col("_label_id")).select("doc_id", "toxic", "slots")


class Model:
    """Known slots in order, their weights and factors, and the bias."""

    def __init__(self, slots: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.slots, self.bias, self.weights, self.factors = slots, bias, weights, factors

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, slots=self.slots, bias=self.bias, weights=self.weights, factors=self.factors)
        return out.getvalue()

    @classmethod
    def parse(cls, data: bytes) -> Model:
        found = np.load(io.BytesIO(data))
        return cls(found["slots"], float(found["bias"]), found["weights"], found["factors"])

    def margin(self, at: list[int]) -> float:
        """Score before the sigmoid of a document with the known slots ``at`` (positions in ``slots``)."""
        if not at:
            return self.bias
        v = self.factors[at]
        total = v.sum(axis=0)
        return self.bias + float(self.weights[at].sum()) + 0.5 * float(total @ total - np.einsum("ij,ij->", v, v))


class _Batch:
    """Some documents' known slots, row by row for the scores and slot by slot for the gradient."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.labels = labels
        self.at = np.concatenate(rows)
        sizes = [len(r) for r in rows]
        self.row_starts = np.r_[0, np.cumsum(sizes)[:-1]]
        by_slot = np.argsort(self.at, kind="stable")
        self.rows = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[by_slot]
        self.slots, self.slot_starts = np.unique(self.at[by_slot], return_index=True)

    def gradient(self, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the mean logistic loss by the weights and factors of ``slots``, and by the bias."""
        mine = v[self.at]
        s = np.add.reduceat(mine, self.row_starts)
        squares = np.add.reduceat(np.einsum("ij,ij->i", mine, mine), self.row_starts)
        z = bias + np.add.reduceat(w[self.at], self.row_starts) + 0.5 * ((s * s).sum(1) - squares)
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.labels) / len(s)).astype(np.float32)
        gw = np.add.reduceat(g[self.rows], self.slot_starts)
        gv = np.add.reduceat((g[:, None] * s)[self.rows], self.slot_starts) - gw[:, None] * v[self.slots]
        return gw, gv, float(g.sum())


def _likelihood_ratio(with_pos: np.ndarray, with_all: np.ndarray, pos: int, total: int) -> np.ndarray:
    """G statistic of having a slot against the label."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    share = pos / total
    without_pos, without = pos - with_pos, total - with_all
    return 2 * (
        part(with_pos, with_all * share)
        + part(with_all - with_pos, with_all * (1 - share))
        + part(without_pos, without * share)
        + part(without - without_pos, without * (1 - share))
    )


def _descend(rows: list[np.ndarray], toxic: np.ndarray, slots: int, bias: float, steps: int, shrink: Shrink) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors of ``slots`` slots by Adam over batches of documents, each the positions of its slots."""
    n = len(rows)
    rng = np.random.default_rng(8)
    order = rng.permutation(n)
    # The last position is nobody's slot: a document without any still has a row. It stays at zero.
    padded = [np.append(rows[i], np.int32(slots)) for i in order]
    y = toxic[order].astype(np.float32)
    batches = [_Batch(padded[i : i + shrink.batch], y[i : i + shrink.batch]) for i in range(0, n, shrink.batch)]
    w = np.zeros(slots + 1, np.float32)
    v = rng.normal(0, 0.01, (slots + 1, FACTORS)).astype(np.float32)
    v[-1] = 0
    params, decay = (w, v), (shrink.weights, shrink.factors)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    bias_first = bias_second = 0.0
    least = shrink.rate * shrink.errors * float(np.sqrt(shrink.batch / max(n, shrink.batch)))
    turns = (i for _ in range(1 + steps // len(batches)) for i in rng.permutation(len(batches)))
    for step, i in zip(range(1, steps + 1), turns):
        *grads, gb = batches[i].gradient(bias, w, v)
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        for p, grad, l2, m1, m2 in zip(params, grads, decay, first, second, strict=True):
            full = l2 * p
            full[batches[i].slots] += grad
            full[-1] = 0
            m1 += 0.1 * (full - m1)
            full *= full
            m2 += 0.001 * (full - m2)
            p -= (shrink.rate / c1) * m1 / (np.sqrt(m2 / c2) + 1e-8)
        if least:
            np.copyto(w, np.sign(w) * np.maximum(np.abs(w) - least, 0))
        bias_first += 0.1 * (gb - bias_first)
        bias_second += 0.001 * (gb * gb - bias_second)
        bias -= shrink.rate * (bias_first / c1) / (np.sqrt(bias_second / c2) + 1e-8)
    return bias, w[:-1], v[:-1]


def fit(documents: list[np.ndarray], toxic: np.ndarray) -> Model:
    """Train on documents given as sorted arrays of slots; the same rows in the same order give the same model."""
    n, pos = len(documents), int(toxic.sum())
    rate = (pos + 0.5) / (n + 2)
    bias = float(np.log(rate / (1 - rate)))
    nothing = Model(np.zeros(0, np.int32), bias, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    if pos == 0 or pos == n:
        return nothing
    size = 1 << HASH_BITS
    have, have_pos = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for d, y in zip(documents, toxic, strict=True):
        have[d] += 1
        have_pos[d] += int(y)

    def placed(known: np.ndarray) -> list[np.ndarray]:
        place = np.full(size, -1, np.int32)
        place[known] = np.arange(len(known), dtype=np.int32)
        return [at[at >= 0] for at in (place[d] for d in documents)]

    common = np.flatnonzero(have >= MIN_DOCUMENTS)
    if not len(common):
        return nothing
    _, _, factors = _descend(placed(common), toxic, len(common), bias, STEPS, SCREEN)
    norm = np.linalg.norm(factors, axis=1)
    gain = _likelihood_ratio(have_pos[common].astype(float), have[common].astype(float), pos, n)
    alone = np.argsort(-gain, kind="stable")[:ALONE]
    paired = np.argsort(-norm, kind="stable")[:PAIRED]
    known = common[np.union1d(alone[gain[alone] > 0], paired)].astype(np.int32)
    bias, weights, factors = _descend(placed(known), toxic, len(known), bias, EPOCHS * -(-n // FINAL.batch), FINAL)
    return Model(known, float(bias), weights, factors)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit the machine in one task on the bounded sample; only its fixed-size parameters reach the driver."""

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "slots"], kind="stable")
        found = [np.frombuffer(s, dtype=np.int32) for s in frame["slots"]]
        return pd.DataFrame({"model": [fit(found, frame["toxic"].to_numpy()).dump()]})

    sample = training_rows(docs, labels, rows)
    made = sample.groupBy(F.lit(0).alias("_one")).applyInPandas(fitted, "model binary").first()
    return Model.parse(made["model"]) if made else fit([], np.zeros(0))


def scorer(model: Model):
    """A function from UTF-8 texts to scores; words seen before are looked up, not hashed again."""
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[model.slots] = np.arange(len(model.slots), dtype=np.int32)
    known = array("i", place.tobytes())

    def scores(texts) -> list[float]:
        cache = scores.cache
        found = []
        for text in texts:
            at = set()
            for w in set(corpus.words(text)):
                i = cache.get(w)
                if i is None:
                    if len(cache) > 300_000:
                        cache.clear()
                    i = cache[w] = tuple(known[s] for s in word_slots(w) if known[s] >= 0)
                if i:
                    at.update(i)
            margin = model.margin(sorted(at))
            found.append(float(1 / (1 + np.exp(-np.clip(margin, -60, 60)))))
        return found

    scores.cache = {}
    return scores


def scored(docs: DataFrame, model: Model, keep: list[Column], schema: str) -> DataFrame:
    """``keep`` (with its ``schema``) and the ``score`` of every document."""
    score = scorer(model)
    return corpus.each_text(docs, keep, lambda texts: {"score": score(texts)}, f"{schema}, score double")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer(model)
        for texts in batches:
            yield pd.Series(score(texts), dtype="float64")

    return docs.where(toxicity(corpus.text_bytes()) < THRESHOLD)
