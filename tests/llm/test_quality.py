from __future__ import annotations

import math
import random

import numpy as np
import pytest

from thriftline.llm import quality


def plain_counts(text: str | None) -> tuple:
    text = text or ""
    words, now = [], ""
    for c in text + " ":
        if c in " \t\n\r\x0b\x0c":
            words += [now] if now else []
            now = ""
        else:
            now += c
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def texts(rng: random.Random) -> list[str | None]:
    pool = ["the", "of", "é", "a|b", "$$$", "\x1f", " ", "long" * 5]
    made: list[str | None] = [None, "", " \n\t ", "x" * 300, "a b c d e " * 6, "a b c d e a b c d e a b c d"]
    for _ in range(150):
        made.append("".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(0, 40))))
    return made


def test_counts_equal_the_plain_rules():
    for text in texts(random.Random(1)):
        assert quality.measure((text or "").encode()) == plain_counts(text)


def test_chi_squared_points():
    assert quality.tail_point(0.05, 4) == pytest.approx(9.4877, abs=1e-3)
    assert quality.tail_point(0.025, 4) == pytest.approx(11.1433, abs=1e-3)
    assert quality.consistency(1.0 - 1e-9, 4) == pytest.approx(1.0, abs=1e-3)


def plain_estimate(x: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The stated estimate of one group of fixed-point vectors."""
    floor = np.diag(np.square(quality.RESOLUTION))
    values = x / quality.UNIT
    factor = quality.consistency(quality.KEPT, 4)
    middle = np.median(x, axis=0)
    spread = 1.4826 * np.median(np.abs(x - middle), axis=0) / quality.UNIT
    found = []
    for mean, cov in ((middle / quality.UNIT, np.diag(spread**2)), (values.mean(0), np.cov(values.T, bias=True))):
        cov = cov + floor
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", values - mean, np.linalg.inv(cov), values - mean)
            bins = np.floor(np.log2(d + 1e-6) * 32)
            near = values[bins <= math.ceil(np.percentile(bins, 100 * quality.KEPT))]
            mean, cov = near.mean(0), factor * np.cov(near.T, bias=True) + floor
        found.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(found, key=lambda f: f[0])
    d = np.einsum("ij,jk,ik->i", values - mean, np.linalg.inv(cov), values - mean)
    near = values[d <= quality.tail_point(0.025, 4)]
    return near.mean(0), quality.consistency(0.975, 4) * np.cov(near.T, bias=True) + floor


def test_estimates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    groups = {}
    for key in ("a", "b"):
        core = rng.normal([1.6, 0.1, 0.2, 0.5], [0.1, 0.3, 0.2, 0.4], (400, 4))
        core[:60] += rng.normal([0.5, 3, 2, 2], 0.1, (60, 4))
        groups[key] = np.round(core * quality.UNIT).astype(int)
    rows = [(key, *map(int, x), 1) for key, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "key string, x0 bigint, x1 bigint, x2 bigint, x3 bigint, w bigint").repartition(4)
    found = {r.key: r for r in quality.estimates(df).collect()}
    for key, xs in groups.items():
        mean, cov = plain_estimate(xs, quality.STEPS)
        inverse = np.linalg.inv(cov)
        assert found[key]["mean"] == pytest.approx(mean.tolist(), rel=1e-9)
        assert found[key].inverse == pytest.approx([inverse[i, j] for i in range(4) for j in range(i, 4)], rel=1e-6)


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(rng.randint(15, 200))) for _ in range(500)]
    junk = [" ".join(word() + "$$$" for _ in range(100)) for _ in range(60)]
    extra = texts(rng)[:6]
    rows = [(i, t, "en" if i % 7 else None, "hot" if i % 3 else None) for i, t in enumerate([*clean, *junk, *extra])]
    rows += [rows[0], (None, clean[1], "en", "hot")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, lang string, source string, distance double")
    found = quality.judged(df.repartition(3)).collect()
    assert len(found) == len(rows)
    verdict = {r.doc_id: r for r in found}
    assert all(verdict[i].kept for i in range(500)) and not any(verdict[i].kept for i in range(500, 560))
    for i, text in enumerate(extra, 560):
        n_words, chars, symbols, dup, again = plain_counts(text)
        r = verdict[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, chars, symbols, dup, again)
        assert r.base_failed == (n_words < 10 or 100 * again > 20 * n_words) and not (r.base_failed and r.kept)
    again = quality.judged(df.repartition(6)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_few_and_no_documents(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "en", "s")], "doc_id bigint, text string, lang string, source string")
    assert [r.kept for r in quality.judged(df).collect()] == [True]
    assert quality.judged(df.limit(0)).count() == 0
