"""Phrases whose words stand together more often than chance, from a weighted de Bruijn graph.

Texts are cut into pieces and pieces into words.  Nodes of the graph are three words in a row, edges four: an edge
joins the nodes that overlap in its two middle words and weighs as often as its words occur.

* **Blocks.**  Tasks turn texts into blocks: the distinct words of some megabytes of one language with their
  counts, and the texts as places in that list.  Word counts are summed over blocks; words below the threshold cannot be
  in a candidate, so they end pieces as well, and the others get numbers, which every block gets back for its words.
  Places run from the most frequent word of the block on and are written byte by byte of their size, compressed (:func:`packed`).
* **Pairs.**  Blocks count their pairs of numbered words; pairs below the threshold over all blocks end pieces too, as no
  candidate holds one.  Every block gets back which of its pairs are left.
* **Edges.**  Each position of a block starts an edge, or a shorter gram where the piece ends before (the piece-end
  correction).  Equal ones are counted in the block, then over all blocks.
* **Shorter counts.**  A node's count is the flow that leaves it plus the pieces that end there; a pair's count is the sum
  of its nodes' counts plus the pieces that end with it.  Each is an aggregate of the counts one word longer.
* **Unary paths.**  A node through which all of its count comes in by one edge and leaves by one edge lies inside
  a path; its edges become one path with one weight.  Inner nodes have their path's weight and stand in a longer phrase
  just as frequent, so they are no candidates to look at again.

Scores are whole numbers from decimals, as their products may pass 64 bits.

Defined results: a NULL or empty text has no words; a NULL language is ``und``; repeated rows count each; phrases of equal
score are ordered by count, then by bytes; no documents give no rows.  A text may have any length and is in memory whole.
Word numbers are packed in pairs, which :func:`numbered_words` checks (2 ** 31 frequent words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thriftline.llm import components, corpus
from thriftline.session import written

LONGEST = 4
LEAST = 30
TOP = 2000
#: A longer phrase with this percentage of a phrase's count takes its place.
ABSORBS = 80
SCALE = 2_000_000
#: Bytes of text of one language in a block; a longer text is a block of its own.
BLOCK = 8 << 20

_STOPS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_STOPS, b"\n" * len(_STOPS))
_END = b"\xff"  # in no UTF-8 text


def words_and_ends(text: bytes) -> list[bytes]:
    """The words of a text, with :data:`_END` behind every piece."""
    return (text.lower().translate(_PLAIN).replace(b"\n", b" " + _END + b" ") + b" " + _END).split()


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, all their lowest bytes first; high bytes are mostly zero and take next to no room."""
    raw = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(held: bytes) -> np.ndarray:
    raw = pa.decompress(memoryview(held)[8:], int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int32)


def _block(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, bytes]:
    """Distinct words, most frequent first, how often each occurs, and the texts as places in them from 1 on (0 where a piece ends)."""
    listed = pa.array([w for t in texts for w in words_and_ends(t)], pa.binary()).dictionary_encode()
    places = listed.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    counts = np.bincount(places, minlength=len(listed.dictionary))
    # The first text ends a piece, so the mark is always there.
    mark = listed.dictionary.index(pa.scalar(_END, pa.binary())).as_py()
    order = np.argsort(-counts, kind="stable")
    order = order[order != mark]
    moved = np.zeros(len(counts), dtype=np.int32)
    moved[order] = np.arange(1, len(order) + 1)
    return listed.dictionary.take(pa.array(order)), counts[order], packed(moved[places])


_BLOCK_TYPES = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
_BLOCK_NAMES = ["block", "lang", "words", "counts", "places"]


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(block, lang, words, counts, places)``: the texts of a task by language, some megabytes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            words, counts, places = _block(held.pop(lang))
            sizes.pop(lang)
            values = [first + made, lang, words.to_pylist(), counts.tolist(), places]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOCK_TYPES)], _BLOCK_NAMES)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= size:
                    yield closed(lang)
                elif sum(sizes.values()) >= 4 * size:
                    yield closed(max(sizes, key=sizes.get))
        for lang in list(held):
            yield closed(lang)

    given = docs.select(F.coalesce("lang", F.lit("und")).alias("_lang"), corpus.text_bytes().alias("_text"))
    return given.mapInArrow(run, "block bigint, lang string, words array<binary>, counts array<bigint>, places binary")


def _block_words(made: DataFrame) -> DataFrame:
    """``(block, lang, place, word, count)``, a row for each distinct word of a block."""
    each = F.posexplode(F.arrays_zip("words", "counts")).alias("place", "_w")
    return made.select("block", "lang", each).select(
        "block", "lang", "place", F.col("_w.words").alias("word"), F.col("_w.counts").alias("count")
    )


def numbered_words(counted: DataFrame, least: int = LEAST) -> DataFrame:
    """``counted`` with an ``id`` for the words with a count ``f`` of ``least`` or more; ids run from 1 over all languages.

    A row's place within its task plus the sizes of the tasks before; the table of sizes has a row for each task.
    """
    kept = written(counted.where(F.col("f") >= least).withColumn("_at", F.monotonically_increasing_id()), "words")
    task = F.shiftright("_at", 33)
    sizes = kept.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    checked = F.when(number < 1 << 31, number).otherwise(F.raise_error(F.lit("over 2 ** 31 frequent words")).cast("bigint"))
    return kept.withColumn("_task", task).join(starts, "_task").select(*counted.columns, checked.alias("id"))


def _heads(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where two numbered words stand together, and the words packed."""
    starts = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return starts, ids[starts] << 32 | ids[starts + 1]


def longest_grams(ids: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of up to four words from each position, two word numbers a column, with counts.

    ``ids`` are word numbers, 0 where a piece ends or a word is too rare; ``kept`` are the packed pairs that do not end a
    piece.  Grams of one word are left out, as words are counted already.
    """
    starts, heads = _heads(ids)
    starts = starts[np.isin(heads, kept)]
    # joined[i]: words i and i + 1 stand together; grams run on as long as they do.
    joined = np.zeros(len(ids) + LONGEST, dtype=bool)
    joined[starts] = True
    padded = np.concatenate([ids, np.zeros(LONGEST, dtype=np.int64)])
    w3 = np.where(joined[starts + 1], padded[starts + 2], 0)
    w4 = np.where(joined[starts + 1] & joined[starts + 2], padded[starts + 3], 0)
    head, tail = padded[starts] << 32 | padded[starts + 1], w3 << 32 | w4
    order = np.lexsort((tail, head))
    head, tail = head[order], tail[order]
    new = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])) if len(head) else order
    return head[new], tail[new], np.diff(np.append(new, len(head)))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places without the rare words, which end pieces, and the word numbers by place."""
    for batch in batches:
        for i in range(batch.num_rows):
            local = batch.column("local")[i].values
            places = unpacked(batch.column("places")[i].as_py())
            at = local.field("place").to_numpy(zero_copy_only=False) + 1
            numbers = np.zeros(max(int(places.max()), int(at.max())) + 1, dtype=np.int32)
            numbers[at] = local.field("id").to_numpy(zero_copy_only=False)
            places[numbers[places] == 0] = 0
            made = [pa.array([packed(x)], pa.binary()) for x in (places, numbers)]
            yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), *made], ["block", "places", "numbers"])


def _ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Word numbers of each block, 0 for a rare word or the end of a piece."""
    for places, numbers in zip(batch.column("places"), batch.column("numbers")):
        yield unpacked(numbers.as_py()).astype(np.int64)[unpacked(places.as_py())]


def _parts(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 18)]) for c in columns], names)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column("block").to_pylist(), _ids(batch)):
            heads, counts = np.unique(_heads(ids)[1], return_counts=True)
            yield from _parts([np.full(len(heads), block), heads, counts], ["block", "head", "c"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, kept in zip(_ids(batch), batch.column("kept")):
            yield from _parts(list(longest_grams(ids, kept.values.to_numpy(zero_copy_only=False))), ["head", "tail", "c"])


def frequent_pairs(coded: DataFrame, least: int) -> DataFrame:
    """``(block, head)``: the pairs of each block whose count over all blocks is ``least`` or more.

    A pair has one row a block, however often it stands there.
    """
    found = coded.mapInArrow(_pairs, "block bigint, head bigint, c bigint")
    return found.withColumn("f", F.sum("c").over(Window.partitionBy("head"))).where(F.col("f") >= least).select("block", "head")


def _first(pair: str) -> Column:
    return F.shiftright(F.col(pair), 32)


def _last(pair: str) -> Column:
    return F.col(pair).bitwiseAND(F.lit((1 << 32) - 1))


def _pair(first: Column, last: Column) -> Column:
    return F.shiftleft(first, 32).bitwiseOR(last)


@dataclass(frozen=True)
class Graph:
    """Counted words and the frequent part of the graph.

    ``totals(lang, n)``, ``words(lang, word, f, id)``, ``pairs(head, f)``, ``nodes(head, third, f, inner)`` and
    ``edges(head, tail, f, path)``; pairs of word numbers are packed into ``head`` and ``tail``.
    """

    totals: DataFrame
    words: DataFrame
    pairs: DataFrame
    nodes: DataFrame
    edges: DataFrame


def _source() -> list[Column]:
    """The node an edge leaves."""
    return [F.col("head").alias("head"), _first("tail").alias("third")]


def _target() -> list[Column]:
    """The node an edge enters."""
    return [_pair(_last("head"), _first("tail")).alias("head"), _last("tail").alias("third")]


def compacted(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with the ``path`` they belong to, and nodes with ``inner`` where a path runs through them.

    ``edges(head, tail, f)`` and ``nodes(head, third, f)`` are the frequent ones, which is all that a path through a
    frequent node can have.  Paths cannot be rings: every piece enters somewhere, and a node where pieces begin has
    more than comes in.
    """
    known = written(edges.withColumn("edge", F.monotonically_increasing_id()), "edges")
    whole = lambda end, name: known.select(*end, F.col("f"), F.col("edge").alias(name))
    through = (
        nodes.select("head", "third", "f")
        .join(whole(_target(), "came"), ["head", "third", "f"])
        .join(whole(_source(), "left"), ["head", "third", "f"])
    )
    inner = written(through, "inner")
    rooted = components.roots(inner.select(F.col("came").alias("a"), F.col("left").alias("b")))
    labelled = known.join(rooted, known["edge"] == rooted["node"], "left").select(
        "head", "tail", "f", F.coalesce("root", "edge").alias("path")
    )
    marked = nodes.join(inner.select("head", "third", F.lit(True).alias("_inner")), ["head", "third"], "left")
    return labelled, marked.select("head", "third", "f", F.coalesce("_inner", F.lit(False)).alias("inner"))


def graph(docs: DataFrame, least: int = LEAST, size: int = BLOCK) -> Graph:
    made = written(blocks(docs, size), "blocks")
    local = _block_words(made)
    # Words meet once, with their places along, a row for each block; no join brings the numbers back.
    counted = local.groupBy("lang", "word").agg(F.sum("count").alias("f"), F.collect_list(F.struct("block", "place")).alias("at"))
    numbered = written(numbered_words(counted, least), "numbered")
    words = numbered.drop("at")
    mine = (
        numbered.select("id", F.explode("at").alias("_at")).select("id", "_at.block", "_at.place")
        .groupBy("block")
        .agg(F.collect_list(F.struct("place", "id")).alias("local"))
    )
    coded = written(made.select("block", "places").join(mine, "block").mapInArrow(_coded, "block bigint, places binary, numbers binary"), "coded")
    kept = frequent_pairs(coded, least).groupBy("block").agg(F.collect_list("head").alias("kept"))
    grams = coded.join(kept, "block").select("places", "numbers", "kept").mapInArrow(_grams, "head bigint, tail bigint, c bigint")
    longest = written(grams.groupBy("head", "tail").agg(F.sum("c").alias("f")), "grams")
    nodes = longest.where("tail > 0").groupBy(*_source()).agg(F.sum("f").alias("f"))
    pairs = longest.groupBy("head").agg(F.sum("f").alias("f"))
    frequent = F.col("f") >= least
    kept_nodes = written(nodes.where(frequent), "nodes")
    edges, nodes = compacted(longest.where(frequent & (_last("tail") > 0)), kept_nodes)
    totals = made.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda n, c: n + c)).alias("n"))
    return Graph(totals, words, written(pairs.where(frequent), "pairs"), written(nodes, "flows"), written(edges, "paths"))


def paths(found: Graph) -> DataFrame:
    """``(path, f, edges)``: the compacted graph, a row for each unary path with its weight and length."""
    return found.edges.groupBy("path").agg(F.first("f").alias("f"), F.count(F.lit(1)).alias("edges"))


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(SCALE * a / (left + right))``, in decimals of up to 27 digits."""
    quotient = F.call_function("div", _exact(a) * F.lit(SCALE).cast("decimal(7,0)"), _exact(left) + _exact(right))
    return quotient.cast("bigint")


def _worst(cuts: list[tuple[Column, Column]]) -> Column:
    """The cut with the lowest score, the earliest of several, as ``(score, cut, l, r)``."""
    return F.array_min(
        F.array(
            *[
                F.struct(_score(F.col("f"), left, right).alias("score"), F.lit(k).alias("cut"), left.alias("l"), right.alias("r"))
                for k, (left, right) in enumerate(cuts, 1)
            ]
        )
    )


def _absorbed() -> Column:
    """A phrase one word longer is nearly as frequent; any longer one lies around one of those, which is no rarer."""
    hundred, share = F.lit(100).cast("decimal(3,0)"), F.lit(ABSORBS).cast("decimal(3,0)")
    return F.coalesce(hundred * _exact(F.col("_longer")) >= share * _exact(F.col("f")), F.lit(False))


def candidates(found: Graph) -> DataFrame:
    """``(head, tail, f, worst)`` of every candidate that no longer phrase absorbs."""
    count = found.words.select("id", "f")
    first = count.select(F.col("id").alias("_1"), F.col("f").alias("u1"))
    last = count.select(F.col("id").alias("_2"), F.col("f").alias("u2"))
    pairs = written(
        found.pairs.withColumns({"_1": _first("head"), "_2": _last("head")}).join(first, "_1").join(last, "_2").select("head", "f", "u1", "u2"),
        "pairs",
    )
    before = pairs.select("head", F.col("f").alias("f12"), "u1")
    after = pairs.select(F.col("head").alias("_23"), F.col("f").alias("f23"), F.col("u2").alias("u3"))
    nodes = written(
        found.nodes.withColumn("_23", _pair(_last("head"), F.col("third"))).join(before, "head").join(after, "_23")
        .select("head", "third", "f", "inner", "u1", "u3", "f12", "f23"),
        "nodes",
    )
    source = nodes.select("head", F.col("third").alias("_3"), F.col("f").alias("f123"), "f12", "u1")
    target = nodes.select(
        F.col("head").alias("_23"), F.col("third").alias("_4"), F.col("f").alias("f234"), F.col("f23").alias("f34"), F.col("u3").alias("u4")
    )
    edges = (
        found.edges.withColumns({"_3": _first("tail"), "_4": _last("tail"), "_23": _pair(_last("head"), _first("tail"))})
        .join(source, ["head", "_3"])
        .join(target, ["_23", "_4"])
    )
    c = F.col
    of_four = edges.select("head", "tail", "f", _worst([(c("u1"), c("f234")), (c("f12"), c("f34")), (c("f123"), c("u4"))]).alias("worst"))
    around = (
        found.edges.select(*_source(), "f").unionByName(found.edges.select(*_target(), "f")).groupBy("head", "third").agg(F.max("f").alias("_longer"))
    )
    of_three = (
        nodes.where(~c("inner")).join(around, ["head", "third"], "left").where(~_absorbed())
        .select("head", F.shiftleft("third", 32).alias("tail"), "f", _worst([(c("u1"), c("f23")), (c("f12"), c("u3"))]).alias("worst"))
    )
    around = (
        nodes.select("head", "f").unionByName(nodes.select(_pair(_last("head"), c("third")).alias("head"), "f"))
        .groupBy("head").agg(F.max("f").alias("_longer"))
    )
    of_two = (
        pairs.join(around, "head", "left").where(~_absorbed())
        .select("head", F.lit(0).cast("bigint").alias("tail"), "f", _worst([(c("u1"), c("u2"))]).alias("worst"))
    )
    return of_four.unionByName(of_three).unionByName(of_two)


def top_phrases(found: Graph, top: int = TOP) -> DataFrame:
    """The first ``top`` candidates of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Words are looked up for what may be among the first by score and count only.
    """
    lang = found.words.select(F.col("id").alias("_1"), "lang")
    scored = candidates(found).select(
        "head", "tail", F.col("f").alias("a"), "worst.score", "worst.l", "worst.r", _first("head").alias("_1")
    ).join(lang, "_1")
    by_score = [F.col("score").desc(), F.col("a").desc()]
    near = written(
        scored.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*by_score))).where(F.col("_rank") <= top).drop("_rank"),
        "near",
    )
    spelt = near.withColumns({"_2": _last("head"), "_3": _first("tail"), "_4": _last("tail")})
    for i in range(1, LONGEST + 1):
        word = found.words.select(F.col("id").alias(f"_{i}"), F.col("word").cast("string").alias(f"w{i}"))
        spelt = spelt.join(word, f"_{i}", "left")
    named = spelt.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(1, LONGEST + 1)]))
    in_order = Window.partitionBy("lang").orderBy(*by_score, F.col("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= top)
    return ranked.join(found.totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, size: int = BLOCK) -> DataFrame:
    return top_phrases(graph(docs, least, size), top)
