"""Masked pseudo-likelihood of documents under a bidirectional window network.

A network predicts every token from ``SIDE`` tokens on either side of it, never from itself: embeddings of the neighbours,
one hidden layer, then a two-step softmax, over ``CLASSES`` classes and over the words of a class.  A document's score is the sum
of its tokens' conditional log-probabilities.

* Vocabulary: counts of all words of all documents, combined before the shuffle; the most frequent words get ids, other words share
  ``RARE`` ids by their last two bytes.  Classes are runs of words sorted from their ends.
* Spelling: what a shared id leaves open is spelled from the word's end, each byte from the two after it, by the counts of all such
  words; divided by what an id's words have in all, so that every word has a probability of its own and they sum to one.
* Training windows: all positions of all documents (``RATE``), dealt in stretches of ids over rounds and shards of about ``SHARD``
  windows, so what is gathered grows with the corpus and no shard does; how rows are split changes nothing.
* Training, in numpy: in each of ``ROUNDS`` rounds the shards go once over that round's part of the windows (``PARTS`` of them, so each
  window trains once) from the same parameters; the results are averaged by a tree of sums, in tasks.  Only the average, of
  fixed size, passes through the driver.
* Scoring runs where the texts are read.
* Texts are split, looked up and spelled some megabytes at a time, in Arrow and numpy; no step runs over words one by one.

Words are runs of anything but ASCII white space, with A-Z in lower case.  Defined results: a NULL or empty text has no
tokens, score 0.0 and a NULL mean; repeated rows are scored each and count each; no documents give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftline.llm import corpus
from thriftline.session import written

SIDE = 2
CLASSES = 64
CLASS_SIZE = 64
RARE = 255
EMBEDDING = 16
HIDDEN = 48
RATE = 1.0
SHARD = 1_000_000
ROUNDS = 3
PARTS = 3
BATCH = 4096
LEARNING_RATE = 5e-3
_STRETCH = 4096
_FAN_IN = 32
_COUNTED = 16 << 20
_ENCODED = 4 << 20
_SCORED = 32_768
_CONTEXTS = 2048
_SYMBOLS = 257
_EDGE = 256
_SAFE = 60

SIZE = CLASSES * CLASS_SIZE
PAD = 0
WORDS = SIZE - RARE - 1

#: Parameters and their shapes, in the order in which they are laid out.
SHAPES = {
    "embed": (SIZE, EMBEDDING), "inner": (2 * SIDE * EMBEDDING, HIDDEN), "inner_bias": (HIDDEN,),
    "to_class": (HIDDEN, CLASSES), "class_bias": (CLASSES,), "to_word": (CLASSES, CLASS_SIZE, HIDDEN), "word_bias": (CLASSES, CLASS_SIZE),
}
_TOTAL = sum(int(np.prod(s)) for s in SHAPES.values())


class Vocabulary:
    """Words with ids; an id's class and place in it are its quotient and remainder by ``CLASS_SIZE``."""

    def __init__(self, words: list[bytes], counts: list[int], total: int):
        # Rare ids lie among the words' by the bytes that they stand for, so that classes have like endings.
        self.ids = {w: i + 1 for i, w in enumerate(sorted(words, key=lambda w: w[::-1]))}
        self.first_rare = SIZE - RARE
        self.frequency = np.zeros(SIZE)
        for w, n in zip(words, counts, strict=True):
            self.frequency[self.ids[w]] = n
        self.frequency[self.first_rare :] = max(total - sum(counts), 0) / RARE
        self.frequency += 1
        self.spelling: Spelling | None = None

    def rare(self, word: bytes) -> int:
        return self.first_rare + zlib.crc32(word[-2:]) % RARE

    def encoder(self) -> Encoder:
        return Encoder(self)


def _together(texts: Iterable[bytes], size: int) -> Iterator[list[bytes]]:
    """Texts in lists of about ``size`` bytes; a longer one ends its list."""
    held: list[bytes] = []
    so_far = 0
    for text in texts:
        held.append(text)
        so_far += len(text)
        if so_far >= size:
            yield held
            held, so_far = [], 0
    if held:
        yield held


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, in order, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    found = lists.values.view(pa.binary())
    # White space at the ends of a text leaves empty words there.
    filled = pc.greater(pc.binary_length(found), 0)
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    sizes = np.diff(before[lists.offsets.to_numpy()])
    return (found if before[-1] == len(found) else found.filter(filled)), sizes


def _inside(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each word ends in the bytes of all, and those bytes."""
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    held = found.buffers()[2]
    every = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    return ends[1:] - ends[0], every[ends[0] : ends[-1]]


class Encoder:
    """Texts to ids, and to what their shared ids leave open."""

    def __init__(self, words: Vocabulary):
        self.known = pa.array(words.ids, pa.binary())
        self.of_known = np.fromiter(words.ids.values(), np.int16, len(words.ids))
        self.rare = words.rare
        self.spelling = words.spelling
        # Ids by the last two bytes, then by the only one, as they come up.
        self.of_ending = np.zeros(257 << 8, np.int16)

    def _rare(self, found: pa.Array) -> np.ndarray:
        ends, held = _inside(found)
        last, before = held[ends - 1].astype(np.int32), held[np.maximum(ends - 2, 0)].astype(np.int32)
        endings = np.where(np.diff(ends, prepend=0) > 1, before, 256) << 8 | last
        for e in np.unique(endings[self.of_ending[endings] == 0]).tolist():
            self.of_ending[e] = self.rare(bytes([e >> 8, e & 255] if e < 1 << 16 else [e & 255]))
        return self.of_ending[endings]

    def together(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, how many each has, and its summed log-probability of the words behind shared ids."""
        found, sizes = split(texts)
        places = pc.index_in(found, value_set=self.known)
        unknown = places.is_null()
        ids = np.empty(len(found), np.int16)
        at = unknown.to_numpy(zero_copy_only=False)
        ids[~at] = self.of_known[places.drop_null().to_numpy()]
        rare = found.filter(unknown)
        ids[at] = self._rare(rare)
        if not self.spelling:
            return ids, sizes, np.zeros(len(texts))
        owner = np.repeat(np.arange(len(texts)), sizes)[at]
        # Without any row bincount gives integers.
        return ids, sizes, np.bincount(owner, self.spelling.each_within(rare, ids[at]), len(texts)).astype(np.float64)

    def __call__(self, text: bytes) -> np.ndarray:
        return self.together([text])[0]

    def spelled(self, text: bytes) -> tuple[np.ndarray, float]:
        """The ids, and the summed log-probabilities of the words behind shared ones."""
        ids, _, opened = self.together([text])
        return ids, float(opened[0])


class Spelling:
    """Probabilities of words that share an id, from counts of bytes by the two bytes after them.

    ``cells`` holds the counts, contexts (hashed into ``_CONTEXTS``) by bytes and the end.
    """

    def __init__(self, cells: np.ndarray, words: Vocabulary):
        plain = cells.sum(0) + 1
        given = cells + 2 * plain / plain.sum()
        self.logs = np.log(given / given.sum(1, keepdims=True)).astype(np.float32)
        self.rare = words.rare
        # All words with an ending, less those that have ids of their own.
        last = self.logs[_context(_EDGE, _EDGE)].astype(float)
        held = np.zeros(SIZE)
        for b in range(256):
            before = np.exp(last[b] + self.logs[_context(_EDGE, b)].astype(float))
            held[self.rare(bytes([b]))] += before[_EDGE]
            for a in range(256):
                held[self.rare(bytes([a, b]))] += before[a]
        for word in words.ids:
            held[self.rare(word)] -= math.exp(self.whole(word))
        self.held = np.log(np.maximum(held, 1e-30))

    def whole(self, word: bytes) -> float:
        """Of a word among all strings of bytes."""
        after, last, total = _EDGE, _EDGE, 0.0
        for b in (*reversed(word), _EDGE):
            total += float(self.logs[_context(after, last), b])
            after, last = last, b
        return total

    def within(self, word: bytes) -> float:
        """Log-probability of a word given its shared id."""
        return min(self.whole(word) - float(self.held[self.rare(word)]), 0.0)

    def each_within(self, found: pa.Array, ids: np.ndarray) -> np.ndarray:
        """:meth:`within` of many words, whose shared ids are ``ids``."""
        if not len(found):
            return np.zeros(0)
        cells, sizes = _cells(found)
        whole = np.add.reduceat(self.logs.ravel()[cells], np.cumsum(sizes) - sizes, dtype=np.float64)
        return np.minimum(whole - self.held[ids], 0.0)


def _context(after, last):
    """Row of two neighbouring bytes; works on arrays too."""
    return (after * 40_503 + last * 8_191) % 65_521 % _CONTEXTS


def _cells(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each word, from its end, the cells of its bytes and of the edge before it; and how many each word has."""
    ends, held = _inside(found)
    sizes = np.diff(ends, prepend=0)
    # Two edges, the word from its end, and the edge that the word ends with; the last word comes first.
    stops = np.cumsum(sizes[::-1] + 3)
    symbols = np.full(len(held) + 3 * len(found), _EDGE, np.int32)
    inner = np.ones(len(symbols), bool)
    for o in (1, 2):
        inner[stops - sizes[::-1] - 1 - o] = False
    at = np.flatnonzero(inner)
    inner[stops - 1] = False
    symbols[inner] = held[::-1]
    cells = _context(symbols[at - 2], symbols[at - 1]) * _SYMBOLS + symbols[at]
    # Turned round as a whole, words are in their order again; a sum does not mind that of its parts.
    return cells[::-1], sizes + 1


def spelling_counts(counts: DataFrame, words: Vocabulary) -> np.ndarray:
    """How often each byte stands before the two after it, over all words without an id of their own."""
    known = list(words.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(_CONTEXTS * _SYMBOLS, np.int64)
        listed = pa.array(known, pa.binary())
        for batch in batches:
            rare = pc.invert(pc.is_in(batch.column(0), value_set=listed))
            found, n = batch.column(0).filter(rare), batch.column(1).filter(rare).to_numpy()
            if len(found):
                seen, sizes = _cells(found)
                np.add.at(cells, seen, np.repeat(n, sizes))
        seen = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(cells[seen])], ["cell", "n"])

    added = counts.select("word", "n").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(_CONTEXTS * _SYMBOLS)
    cells[added["cell"].to_numpy()] = added["n"].to_numpy()
    return cells.reshape(_CONTEXTS, _SYMBOLS)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (text.as_py() for batch in batches for text in batch.column(0))
        for some in _together(texts, _COUNTED):
            found = split(some)[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    parts = docs.select(corpus.text_bytes().alias("_text")).mapInArrow(run, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int = WORDS) -> tuple[Vocabulary, int]:
    """The most frequent words (ties by their bytes), and the number of tokens."""
    counts = written(word_counts(docs), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.col("n").desc(), "word").limit(size).collect()
    words = Vocabulary([bytes(r["word"]) for r in top], [r["n"] for r in top], total)
    words.spelling = Spelling(spelling_counts(counts, words), words)
    return words, total


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The neighbours of positions ``at``, ``PAD`` beyond the ends."""
    return _neighbours(np.pad(ids, SIDE, constant_values=PAD), at + SIDE)


def _neighbours(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([padded[at + o] for o in range(-SIDE, SIDE + 1) if o], axis=1)


def _padded(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with ``PAD`` around each text, and where the ids are."""
    at = np.arange(len(ids)) + SIDE * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded = np.full(len(ids) + SIDE * (len(sizes) + 1), PAD, "<i2")
    padded[at] = ids
    return padded, at


def training_texts(docs: DataFrame, words: Vocabulary, shards: int, parts: int = 1) -> DataFrame:
    """``(part, shard, ids)``: stretches of ids between their neighbours, 16 bits each; where one goes depends on its document only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(words)
        encode.spelling = None
        for batch in batches:
            to: list[int] = []
            held: list[bytes] = []
            names = iter(batch.column(0).to_pylist())
            for texts in _together((text.as_py() for text in batch.column(1)), _ENCODED):
                ids, sizes, _ = encode.together(texts)
                every = memoryview(_padded(ids, sizes)[0].tobytes())
                for n, size, start in zip(range(len(sizes)), sizes.tolist(), (np.cumsum(sizes) - sizes).tolist(), strict=True):
                    doc_id, start = next(names), start + SIDE * n
                    for at in range(0, size, _STRETCH):
                        held.append(bytes(every[2 * (start + at) : 2 * (start + min(at + _STRETCH, size) + 2 * SIDE)]))
                        to.append(zlib.crc32(held[-1], zlib.crc32(f"{doc_id} {at}".encode())) % (shards * parts))
            part, shard = np.divmod(np.array(to, np.int32), np.int32(shards))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(shard), pa.array(held, pa.binary())], ["part", "shard", "ids"])

    return docs.select("doc_id", corpus.text_bytes().alias("_text")).mapInArrow(run, "part int, shard int, ids binary")


def windows(stretches: list[bytes], rate: float = RATE) -> np.ndarray:
    """Rows of neighbours and target of every position, or of a share ``rate`` of them."""
    ids = np.frombuffer(b"".join(stretches), dtype="<i2")
    ends = np.cumsum([len(s) // 2 for s in stretches])
    inner = np.ones(len(ids), bool)
    for o in range(SIDE):
        inner[ends - 1 - o] = False
        inner[np.r_[0, ends[:-1]] + o] = False
    at = np.flatnonzero(inner)
    if rate < 1:
        at = at[np.random.default_rng(7).random(len(at)) < rate]
    return np.stack([ids[at + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1), 0)], axis=1)


class Network:
    """Parameters as named views of one flat vector."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        self.views, at = {}, 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            self.views[name] = flat[at : at + n].reshape(shape)
            at += n

    def __getitem__(self, name: str) -> np.ndarray:
        return self.views[name]

    @classmethod
    def start(cls, words: Vocabulary) -> Network:
        """Small random weights; biases that give each word its frequency."""
        rng = np.random.default_rng(11)
        net = cls(np.zeros(_TOTAL, np.float32))
        for name, scale in (("embed", 0.1), ("inner", 0.15), ("to_class", 0.05), ("to_word", 0.05)):
            net[name][:] = rng.normal(0, scale, SHAPES[name])
        share = (words.frequency / words.frequency.sum()).reshape(CLASSES, CLASS_SIZE)
        net["class_bias"][:] = np.log(share.sum(1))
        net["word_bias"][:] = np.log(share / share.sum(1, keepdims=True))
        return net

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.take(self["embed"], context, axis=0).reshape(len(context), -1)
        h = x @ self["inner"]
        h += self["inner_bias"]
        return x, np.tanh(h, out=h)


def _in_range(z: np.ndarray) -> np.ndarray:
    """In place, each row less its largest value where exponentials would leave the range of floats."""
    if z.max(initial=0) > _SAFE or z.min(initial=0) < -_SAFE:
        z -= z.max(axis=1, keepdims=True)
    return z


def _sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


def _by_class(target: np.ndarray) -> np.ndarray:
    """Order by class; numbers of 16 bits are sorted without comparisons."""
    return np.argsort((target // CLASS_SIZE).astype(np.int16), kind="stable")


def _log_shares(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of one place of each row's softmax; ``z`` is overwritten."""
    _in_range(z)
    found = z[np.arange(len(z)), at]
    return found - np.log(_sums(np.exp(z, out=z)))


def log_probabilities(net: Network, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Conditional log-probability of each target."""
    order = _by_class(target)
    context, target = context[order], target[order]
    group, place = target // CLASS_SIZE, target % CLASS_SIZE
    found = np.empty(len(order), np.float32)
    h = np.empty((len(order), HIDDEN), np.float32)
    # Few rows at a time, which stay in the processor's cache.
    for at in range(0, len(order), BATCH):
        rows = slice(at, at + BATCH)
        h[rows] = net.hidden(context[rows])[1]
        z = h[rows] @ net["to_class"]
        z += net["class_bias"]
        found[rows] = _log_shares(z, group[rows])
    for c, start, stop in _runs(group):
        for at in range(start, stop, BATCH):
            rows = slice(at, min(at + BATCH, stop))
            z = h[rows] @ net["to_word"][c].T
            z += net["word_bias"][c]
            found[rows] += _log_shares(z, place[rows])
    out = np.empty(len(order), np.float32)
    out[order] = found
    return out


def _runs(group: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal values in a sorted array."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(group) else []
    return list(zip(group[starts].tolist(), starts, [*starts[1:], len(group)], strict=True))


def gradient(net: Network, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the mean negative log-probability, laid out like the parameters."""
    n = len(target)
    grad = Network(np.zeros(_TOTAL, np.float32))
    order = _by_class(target)
    context, target = context[order], target[order]
    group, place = target // CLASS_SIZE, target % CLASS_SIZE
    x, h = net.hidden(context)
    rows, ones = np.arange(n), np.ones(n, np.float32)

    def errors(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        """In place: the softmax of each row, less 1 where the target is, over ``n``."""
        np.exp(_in_range(z), out=z)
        z *= (1 / (n * _sums(z)))[:, None]
        z[rows, at] -= np.float32(1 / n)
        return z

    at_class = h @ net["to_class"]
    at_class += net["class_bias"]
    errors(at_class, group)
    np.matmul(h.T, at_class, out=grad["to_class"])
    np.matmul(ones, at_class, out=grad["class_bias"])
    back = at_class @ net["to_class"].T
    # Class by class only what has to be; products of few rows cost more in calls than in sums.
    runs, to_word = _runs(group), net["to_word"]
    at_word = np.take(net["word_bias"], group, axis=0)
    for c, start, stop in runs:
        at_word[start:stop] += h[start:stop] @ to_word[c].T
    errors(at_word, place)
    more = np.empty_like(back)
    for c, start, stop in runs:
        mine = at_word[start:stop]
        np.matmul(mine.T, h[start:stop], out=grad["to_word"][c])
        np.matmul(ones[start:stop], mine, out=grad["word_bias"][c])
        np.matmul(mine, to_word[c], out=more[start:stop])
    back += more
    np.multiply(h, h, out=more)
    np.subtract(1, more, out=more)
    back *= more
    np.matmul(x.T, back, out=grad["inner"])
    np.matmul(ones, back, out=grad["inner_bias"])
    into = (back @ net["inner"].T).reshape(-1, EMBEDDING)
    ids = context.ravel().astype(np.int16)
    by_id = np.argsort(ids, kind="stable")
    sorted_ids = ids[by_id]
    starts = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
    # Complex numbers add up two columns at once.
    grad["embed"][sorted_ids[starts]] = np.add.reduceat(np.take(into, by_id, axis=0).view(np.complex64), starts, axis=0).view(np.float32)
    return grad.flat


def train_shard(flat: np.ndarray, windows: np.ndarray, seed: int) -> np.ndarray:
    """One pass of Adam over a shard's windows, from ``flat``."""
    net = Network(flat.astype(np.float32))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(windows))
    batch = int(min(BATCH, max(64, len(windows) // 100)))
    first, second, by = (np.zeros(_TOTAL, np.float32) for _ in range(3))
    for step, at in enumerate(range(0, len(order), batch), 1):
        rows = windows[order[at : at + batch]]
        g = gradient(net, rows[:, :-1], rows[:, -1])
        # first += 0.1 * (g - first); second += 0.001 * (g * g - second)
        np.subtract(g, first, out=by)
        by *= 0.1
        first += by
        np.multiply(g, g, out=by)
        by -= second
        by *= 0.001
        second += by
        # flat -= rate * first / (sqrt(second) + 1e-8)
        np.sqrt(second, out=by)
        by += 1e-8
        np.divide(first, by, out=by)
        by *= float(LEARNING_RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
        net.flat -= by
    return net.flat


def averaged(parts: DataFrame) -> np.ndarray | None:
    """Mean of the parameter vectors of ``(id, n, flat)`` rows weighted by ``n``: sums of few at a time, level by level."""

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        total = np.zeros(_TOTAL, np.float64)
        for flat in frame["flat"]:
            total += np.frombuffer(flat, dtype="<f8")
        return pd.DataFrame({"id": [int(frame["id"].min()) // _FAN_IN], "n": [int(frame["n"].sum())], "flat": [total.tobytes()]})

    rows = parts.count()
    while rows > 1:
        parts = written(
            parts.groupBy(F.floor(F.col("id") / _FAN_IN).alias("_node")).applyInPandas(added, "id bigint, n bigint, flat binary"), "sums"
        )
        rows = parts.count()
    last = parts.first()
    return None if last is None or not last["n"] else (np.frombuffer(last["flat"], dtype="<f8") / last["n"]).astype(np.float32)


def _trainer(flat: np.ndarray, turn: int, rate: float):
    def trained(frame: pd.DataFrame) -> pd.DataFrame:
        # In an order of their own, not that of arrival.
        rows = windows(sorted(frame["ids"], key=lambda b: (zlib.crc32(b), b)), rate)
        made = train_shard(flat, rows, turn) * float(len(rows))
        return pd.DataFrame({"id": [int(frame["shard"].iloc[0])], "n": [len(rows)], "flat": [made.astype("<f8").tobytes()]})

    return trained


def train(
    docs: DataFrame, words: Vocabulary, total: int, rounds: int = ROUNDS, rate: float = RATE, shard: int = SHARD, parts: int = PARTS
) -> Network:
    """Parallel training: every shard from the round's parameters over the round's part of the windows, then the average."""
    shards = max(1, round(total * rate / parts / shard))
    texts = written(training_texts(docs, words, shards, parts), "stretches")
    net = Network.start(words)
    for turn in range(rounds):
        mine = texts.where(F.col("part") == turn % parts).drop("part")
        mean = averaged(written(mine.groupBy("shard").applyInPandas(_trainer(net.flat, turn, rate), "id bigint, n bigint, flat binary"), "trained"))
        if mean is not None:
            net = Network(mean)
    return net


def document_scores(texts: Iterable[bytes], encode: Encoder, net: Network) -> tuple[list[int], list[float]]:
    """Token counts and summed log-probabilities; many short texts, or parts of a long one, go through the network at once."""
    counts: list[int] = []
    sums: list[float] = []
    for some in _together(texts, _ENCODED):
        ids, sizes, opened = encode.together(some)
        padded, at = _padded(ids, sizes)
        found = np.empty(len(ids), np.float32)
        for start in range(0, len(ids), _SCORED):
            part = at[start : start + _SCORED]
            found[start : start + _SCORED] = log_probabilities(net, _neighbours(padded, part), padded[part])
        counts += sizes.tolist()
        sums += (np.bincount(np.repeat(np.arange(len(sizes)), sizes), found, len(sizes)) + opened).tolist()
    return counts, sums


def scored(docs: DataFrame, words: Vocabulary, net: Network) -> DataFrame:
    """``(doc_id, n_tokens, log_probability, mean_log_probability)`` of every document."""
    made: dict = {}
    flat = net.flat

    def measure(texts: Iterable[bytes]) -> dict[str, list]:
        if not made:
            made.update(encode=words.encoder(), net=Network(flat))
        counts, sums = document_scores(texts, made["encode"], made["net"])
        return {
            "n_tokens": counts,
            "log_probability": [round(s, 3) for s in sums],
            "mean_log_probability": pa.array([round(s / n, 5) if n else None for n, s in zip(counts, sums, strict=True)], pa.float64()),
        }

    schema = "doc_id bigint, n_tokens bigint, log_probability double, mean_log_probability double"
    return corpus.each_text(docs, [F.col("doc_id").cast("bigint").alias("doc_id")], measure, schema)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Vocabulary, training and scoring over the same documents."""
    words, total = vocabulary(docs)
    return scored(docs, words, train(docs, words, total))
