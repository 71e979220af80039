from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from thriftline.llm import packing

WIDE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text: str | None) -> np.ndarray:
    return np.asarray([*WIDE.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def check(rows: list, docs: list[tuple], window: int, tasks: int) -> int:
    """Every id lies in one piece, sequences have no gaps; the padding."""
    want = sorted((i if i is not None else -1, zlib.crc32(ids_of(t).tobytes()), len(ids_of(t))) for i, t in docs)
    pieces: dict = {}
    for r in rows:
        pieces.setdefault((r.doc_id if r.doc_id is not None else -1, r.doc_tokens), []).append(r)
    texts = {}
    for i, t in docs:
        texts.setdefault((i if i is not None else -1, len(ids_of(t))), []).append(ids_of(t))
    assert set(pieces) == set(texts)
    for key, found in pieces.items():
        spans = sorted((p.start, p.length) for p in found)
        copies = len(texts[key])
        covered = np.zeros(key[1], int)
        for start, length in spans:
            covered[start : start + length] += 1
        assert (covered == copies).all()
        for p in found:
            assert p.ids_crc32 in {zlib.crc32(t[p.start : p.start + p.length].tobytes()) for t in texts[key]}
    assert sum(r.length for r in rows) == sum(n for _, _, n in want)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = short = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
        short += at < window
        padding += window - at
    assert short <= tasks
    return padding


def test_pieces_rebuild_documents(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["tion", "the", "Éñ", "$$$", "x\n\ny"]) for _ in range(rng.choice([1, 9, 300, 2500])))) for i in range(60)]
    docs += [(None, None), (100, ""), (101, "a <|endoftext|> b"), (102, "w" * 5000), (103, "日本語　   x\x85y"), (5, docs[5][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, start int").repartition(3)
    check(packing.packed(df).collect(), docs, 1024, 3)
    check(packing.packed(df, window=64).collect(), docs, 64, 3)


def test_ids_equal_the_general_tokenizer():
    encode = packing.Encoder()
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    texts += ["don't  stop\r\n\tnow ", " a", "x" * 3000, "<|endoftext|>", " ", "\n\n\n", "a b", "1²³ ⅷ"]
    assert all(encode(t) == ids_of(t)[:-1].tobytes() for t in texts)


def test_level_choice_is_the_least_sum_of_squares():
    rng = random.Random(7)
    packer = packing.Packer(40)
    for i in range(3000):
        size = rng.choice([3, 7, 11, 13, 19, 22, 40])
        before = packer.levels.copy()
        filled = packer.place(packing.Piece(i, 0, bytes(4 * size), size))
        costs = {}
        for h in [0, *[h for h in range(1, 40) if before[h] and h + size <= 40]]:
            n = before.copy()
            n[h] -= h > 0
            if h + size < 40:
                n[h + size] += 1
            costs[h] = int((n * n).sum())
        assert int((packer.levels**2).sum()) == min(costs.values())
        assert filled is None or sum(map(len, filled)) == 40


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
