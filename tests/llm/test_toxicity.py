from __future__ import annotations

import random
import zlib

import numpy as np

from thriftline.llm import toxicity


def corpus(n: int, seed: int) -> list[tuple]:
    """Toxic means an insult with a group; either alone is not."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += [rng.choice(["Idiots,", "(fools)"])] * insult + [rng.choice(["bluefolk", "redfolk."])] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def plain_margin(model: toxicity.Model, text: str) -> float:
    at = [i for i, s in enumerate(model.slots) if s in set(toxicity.document_slots(text.encode()).tolist())]
    pairs = sum(float(model.factors[i] @ model.factors[j]) for i in at for j in at if i < j)
    return model.bias + sum(float(model.weights[i]) for i in at) + pairs


def test_pairs_are_learned_on_held_out_rows(spark):
    rows = corpus(3000, 1)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id bigint, text string, slots int").repartition(3)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (7, None, 1)], "doc_id bigint, toxic int, quality int")
    model = toxicity.train(docs, labels)
    score = toxicity.scorer(model)
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((s >= 0.5) == bool(y) for s, (_, y) in zip(score([t.encode() for t, _ in held]), held))
    assert right / len(held) > 0.97
    for text, _ in held[:50]:
        want = 1 / (1 + np.exp(-plain_margin(model, text)))
        assert abs(score([text.encode()])[0] - want) < 1e-4
    again = toxicity.train(docs.repartition(5), labels)
    assert (again.weights == model.weights).all() and (again.factors == model.factors).all()


def test_training_leaves_the_held_out_fold_alone(spark):
    rows = corpus(600, 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, t int")
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows]
    one = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    two = toxicity.train(docs, spark.createDataFrame(flipped, "doc_id bigint, toxic int"))
    assert (one.weights == two.weights).all()


def test_odd_rows_and_the_filter(spark):
    rows = corpus(1500, 3)
    odd = [(9000, None), (9001, ""), (9002, " ... "), (None, "idiots of the bluefolk"), (5, rows[5][1]), (9003, "w1 " * 100_000)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(*o, "x", 1.0) for o in odd], "doc_id bigint, text string, score string, toxic double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    clean = [i for i, _, y in rows if not y]
    assert len(set(clean) - set(ids)) < 0.03 * len(clean) and {9000, 9001, 9002, 9003} <= set(ids) and None not in ids
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.scorer(nothing)([b"", b"idiot"]) == [0.25, 0.25]
    assert toxicity.without_toxic(docs.limit(0), labels).count() == 0


def test_pairs_that_tell_only_together_are_found_among_many_words():
    rng = random.Random(11)
    rows = []
    for _ in range(4000):
        words = [f"w{rng.randrange(30_000)}" for _ in range(rng.randint(10, 50))]
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words += ["alpha"] * one + ["beta"] * two
        rng.shuffle(words)
        rows.append((" ".join(words).encode(), int(one == two)))
    fitted, held = rows[:3200], rows[3200:]
    model = toxicity.fit([toxicity.document_slots(t) for t, _ in fitted], np.array([y for _, y in fitted]))
    scores = toxicity.scorer(model)([t for t, _ in held])
    assert sum((s >= 0.5) == bool(y) for s, (_, y) in zip(scores, held)) / len(held) > 0.95


def test_an_id_trains_once(spark):
    docs = spark.createDataFrame([(1, "b idiot")] * 500 + [(1, "a idiot"), (2, "fine"), (None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id bigint, toxic int")
    found = toxicity.training_rows(docs, labels).collect()
    assert [(r.doc_id, r.toxic) for r in sorted(found)] == [(i, int(i == 1)) for i in (1, 2) if zlib.crc32(str(i).encode()) % 5]
    assert all(len(r.slots) == 4 * len(toxicity.document_slots(b"b idiot")) for r in found if r.doc_id == 1)
