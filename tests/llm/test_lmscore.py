from __future__ import annotations

import random
import sys
from collections import Counter

import numpy as np
import pytest

from thriftline.llm import lmscore


def sentences(n: int, seed: int) -> list[str]:
    """The middle word follows from its neighbours on both sides together."""
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(5, 30)):
            a, b = rng.choice("pqr"), rng.choice("xyz")
            words += [f"left{a}", f"mid{a}{b}", f"right{b}"]
        made.append(" ".join(words))
    return made


def plain_scores(texts: list, words: lmscore.Vocabulary, net: lmscore.Network) -> list[float]:
    """One token at a time, the softmax over all words written out."""
    out = []
    for text in texts:
        found = (text or "").encode().lower().split()
        ids = [words.ids[w] if w in words.ids else words.rare(w) for w in found]
        total = 0.0
        for i, t in enumerate(ids):
            around = [ids[j] if 0 <= j < len(ids) else lmscore.PAD for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(np.concatenate([net["embed"][c] for c in around]) @ net["inner"] + net["inner_bias"])
            z = np.exp(h @ net["to_class"] + net["class_bias"])
            every = []
            for c in range(lmscore.CLASSES):
                y = np.exp(net["to_word"][c] @ h + net["word_bias"][c])
                every.append(z[c] / z.sum() * y / y.sum())
            every = np.concatenate(every)
            assert every.sum() == pytest.approx(1, abs=1e-4)
            total += float(np.log(every[t]))
        out.append(total)
    return out


def vocab(texts: list[str]) -> lmscore.Vocabulary:
    counts = Counter(w for t in texts for w in t.encode().lower().split())
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lmscore.WORDS]
    return lmscore.Vocabulary([w for w, _ in top], [n for _, n in top], sum(counts.values()))


def test_scores_equal_the_plain_definition(monkeypatch):
    monkeypatch.setattr(lmscore, "_SCORED", 7)
    texts = [*sentences(4, 1), "", "unseen words Here", "leftp"]
    words = vocab(texts[:4])
    net = lmscore.Network.start(words)
    net.flat += np.random.default_rng(2).normal(0, 0.2, net.flat.shape).astype(np.float32)
    counts, sums = lmscore.document_scores([t.encode() for t in texts], words.encoder(), net)
    assert counts == [len(t.split()) for t in texts]
    assert sums == pytest.approx(plain_scores(texts, words, net), rel=1e-4, abs=1e-4)


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    net = lmscore.Network.start(vocab(sentences(3, 1)))
    net.flat[:] = rng.normal(0, 0.3, net.flat.shape)
    context, target = rng.integers(0, 200, (40, 4)), rng.integers(0, lmscore.SIZE, 40)
    grad = lmscore.gradient(net, context, target)
    loss = lambda: -float(lmscore.log_probabilities(net, context, target).mean(dtype=np.float64))
    for at in [*np.argsort(-np.abs(grad))[:30], *rng.integers(0, len(grad), 10)]:
        kept = net.flat[at]
        net.flat[at] = kept + 1e-2
        up = loss()
        net.flat[at] = kept - 1e-2
        down = loss()
        net.flat[at] = kept
        assert grad[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_held_out_texts_are_likelier_after_training(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sentences(900, 5))], "doc_id bigint, text string").repartition(4)
    words, total = lmscore.vocabulary(df)
    assert total == sum(len(t.split()) for t in sentences(900, 5))
    net = lmscore.train(df, words, total, rounds=4, rate=0.5, shard=12_000)
    held = sentences(50, 6)
    mean = lambda n: sum(lmscore.document_scores([t.encode() for t in held], words.encoder(), n)[1]) / sum(len(t.split()) for t in held)
    # Unigrams leave log 3 for each side and log 9 for the middle; the neighbours settle the middle.
    assert mean(net) > mean(lmscore.Network.start(words)) + 0.8


def test_tables(spark):
    rows = [(1, None), (2, ""), (3, "a b a b c"), (3, "a b a b c"), (None, "A  b\x0ba"), (4, "w " * 100_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n int")
    found = lmscore.pseudo_likelihood(df).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in found) == [(-1, 3), (1, 0), (2, 0), (3, 5), (3, 5), (4, 100_000)]
    for r in found:
        assert (r.mean_log_probability is None) == (r.n_tokens == 0) and r.log_probability <= 0
    assert lmscore.pseudo_likelihood(df.limit(0)).count() == 0
    counts = {bytes(r.word): r.n for r in lmscore.word_counts(df).collect()}
    assert counts == {b"a": 6, b"b": 5, b"c": 2, b"w": 100_000}


def test_every_position_trains_however_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "_STRETCH", 7)
    texts = [*sentences(60, 8), None, "", "one", "two words"]
    df = spark.createDataFrame([(i % 50 or None, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    words, total = lmscore.vocabulary(df)
    encode = words.encoder()
    want = Counter()
    for t in texts:
        ids = encode((t or "").encode())
        at = np.arange(len(ids))
        want.update(map(tuple, np.column_stack([lmscore.contexts(ids, at), ids]).tolist()))
    stretches = [bytes(r.ids) for r in lmscore.training_texts(df.repartition(3), words, 5).collect()]
    assert Counter(map(tuple, lmscore.windows(stretches).tolist())) == want and sum(want.values()) == total
    one, four = (lmscore.train(df.repartition(n), words, total, rounds=1, shard=200) for n in (1, 4))
    assert np.array_equal(one.flat, four.flat)


def test_every_rare_word_has_a_probability_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "WORDS", 2)
    texts = ["a a a b b b " * 5 + "ab ba bab cab c é aab " * 2, "c ab", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(2)
    counts = lmscore.word_counts(df)
    words = lmscore.Vocabulary([b"a", b"b"], [15, 15], 60)
    cells = lmscore.spelling_counts(counts, words)
    want = Counter()
    for r in counts.collect():
        if bytes(r.word) not in words.ids:
            found = [256, 256, *reversed(bytes(r.word)), 256]
            for i in range(2, len(found)):
                want[lmscore._context(found[i - 2], found[i - 1]), found[i]] += r.n
    assert {(int(c), int(b)): int(cells[c, b]) for c, b in zip(*np.nonzero(cells))} == want
    words.spelling = lmscore.Spelling(cells, words)
    assert np.exp(words.spelling.logs).sum(1) == pytest.approx(1, abs=1e-4)
    # All words of one or two bytes, and the rest by what the beginnings leave: the words of an id sum to one.
    spell = words.spelling
    share = words.rare(b"ab")
    short = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    same = [w for w in short if words.rare(w) == share and w not in words.ids]
    mass = sum(np.exp(spell.whole(w)) for w in same)
    longer = 0.0
    for w in (w for w in short if len(w) == 2 and words.rare(w) == share):
        longer += np.exp(spell.whole(w) - spell.logs[lmscore._context(w[1], w[0]), 256]) * (1 - np.exp(spell.logs[lmscore._context(w[1], w[0]), 256]))
    assert mass + longer == pytest.approx(float(np.exp(spell.held[share])), rel=1e-3)
    encode = words.encoder()
    ids, open_ = encode.spelled(b"a ab zq b ab")
    assert open_ == pytest.approx(2 * spell.within(b"ab") + spell.within(b"zq"))
    assert spell.within(b"ab") > spell.within(b"qxwv\xff") and (ids == encode(b"a ab zq b ab")).all()


def test_each_window_trains_in_one_part(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "_STRETCH", 7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sentences(40, 9))], "doc_id bigint, text string")
    words, total = lmscore.vocabulary(df)
    rows = lmscore.training_texts(df, words, 2, 3).collect()
    assert {r.part for r in rows} == {0, 1, 2} and {r.shard for r in rows} == {0, 1}
    assert sum(len(lmscore.windows([bytes(r.ids)])) for r in rows) == total


def test_words_of_many_texts_are_those_of_each():
    texts = [b"", b"  ", b" A b\x0bC\x0cd\r\n", b"\x1c\x85 \xc3\x89a \xff\x00Z", b"x" * 9, b"\t", b"end ", "ÉÀ é a".encode()]
    found, sizes = lmscore.split(texts)
    assert found.to_pylist() == [w for t in texts for w in t.lower().split()]
    assert sizes.tolist() == [len(t.split()) for t in texts]
    found, sizes = lmscore.split([])
    assert len(found) == len(sizes) == 0


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_texts_are_encoded_alike_alone_and_together(size):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abé", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 30))).encode() for _ in range(40)]
    counts = Counter(w for t in texts for w in t.split())
    words = lmscore.Vocabulary([w for w, _ in counts.most_common(9)], [n for _, n in counts.most_common(9)], sum(counts.values()))
    words.spelling = lmscore.Spelling(np.random.default_rng(1).integers(0, 50, (lmscore._CONTEXTS, lmscore._SYMBOLS)).astype(float), words)
    encode = words.encoder()
    made = [encode.together(some) for some in lmscore._together(texts, size)]
    want = [[words.ids[w] if w in words.ids else words.rare(w) for w in t.split()] for t in texts]
    assert np.concatenate([ids for ids, _, _ in made]).tolist() == sum(want, [])
    assert np.concatenate([sizes for _, sizes, _ in made]).tolist() == [len(w) for w in want]
    opened = [sum(words.spelling.within(w) for w in t.split() if w not in words.ids) for t in texts]
    assert np.concatenate([o for _, _, o in made]) == pytest.approx(opened, abs=1e-9)


def test_python_calls_do_not_grow_with_the_words():
    def calls(n: int) -> int:
        words = vocab(["a b c"])
        words.spelling = lmscore.Spelling(np.ones((lmscore._CONTEXTS, lmscore._SYMBOLS)), words)
        encode, net = words.encoder(), lmscore.Network.start(words)
        text, seen = " ".join(f"w{i}" for i in range(n)).encode(), []
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event == "call" else None)
        try:
            counts, _ = lmscore.document_scores([text], encode, net)
        finally:
            sys.setprofile(None)
        assert counts == [n]
        return len(seen)

    assert calls(16_000) < calls(2_000) + 2_000


def test_scores_where_exponentials_leave_the_range():
    words = vocab(sentences(3, 1))
    net = lmscore.Network.start(words)
    net.flat *= 1 + np.random.default_rng(5).normal(0, 30, net.flat.shape).astype(np.float32)
    rng = np.random.default_rng(6)
    context, target = rng.integers(0, lmscore.SIZE, (300, 4)), rng.integers(0, lmscore.SIZE, 300)
    exact = lmscore.Network(net.flat.astype(np.float64))
    h = exact.hidden(context)[1]
    share = lambda z: z - z.max(1, keepdims=True) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True))
    group, place = np.divmod(target, lmscore.CLASS_SIZE)
    rows = np.arange(300)
    z = h @ exact["to_class"] + exact["class_bias"]
    y = np.einsum("nh,nkh->nk", h, exact["to_word"][group]) + exact["word_bias"][group]
    assert np.abs(z).max() > lmscore._SAFE and np.abs(y).max() > lmscore._SAFE
    assert lmscore.log_probabilities(net, context, target) == pytest.approx(share(z)[rows, group] + share(y)[rows, place], rel=2e-3, abs=2e-2)
    assert np.isfinite(lmscore.gradient(net, context, target)).all()
