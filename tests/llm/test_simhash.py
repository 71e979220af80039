from __future__ import annotations

import random

import xxhash

from thriftline.llm import components, simhash

MASK = (1 << 64) - 1


def plain_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids: list, prints: list[int], radius: int = 4) -> list:
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(ids[i])
    least = {g: min((x for x in members if x is not None), default=None) for g, members in groups.items()}
    return [least[top(i)] for i in range(len(ids))]


def test_masks_cover_every_pair_within_the_radius():
    tables = simhash.masks(4)
    assert len(tables) == 31
    rng = random.Random(1)
    for _ in range(5000):
        x = rng.getrandbits(64)
        y = x
        for i in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << i
        assert any(x & m == y & m for m in tables)


def texts(rng: random.Random) -> list[tuple]:
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.choice([1, 3, 5, 40, 300]))) for _ in range(40)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 4)):
            parts = b.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                parts[rng.randrange(len(parts))] = word()
            rows.append(" ".join(parts))
    rows += [None, "", " \t\n", "A b", "a B", "x y 　 z", base[0].upper(), base[0]]
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = texts(random.Random(3)) + [(None, "only here without an id " * 30), (2000, "y " * 70000)]
    rows += [rows[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string").repartition(5)
    for bucket in (simhash.BUCKET, 1):
        found = simhash.near_duplicates(df, bucket=bucket).collect()
        prints = [plain_fingerprint(t) for _, t in rows]
        want = sorted(zip([i for i, _ in rows], prints, plain_components([i for i, _ in rows], prints)), key=str)
        assert sorted(((r.doc_id, r.fp & MASK, r.component_id) for r in found), key=str) == want


def test_one_of_each_group_stays_with_all_columns(spark):
    long_text = "one two three four five six seven eight nine ten " * 20
    rows = [(3, long_text), (1, long_text), (1, long_text), (2, "something else entirely " * 9), (None, long_text)]
    rows += [(None, "no id at all here " * 9), (None, "no id at all here " * 9)]
    # One id, two texts: the first of one group, not the first of the other; and the first of two groups.
    rows += [(5, "something else entirely " * 9), (5, "a text of its own it is " * 9), (6, "left of two " * 9), (6, "right of both " * 9)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, root string, _fp int")
    kept = simhash.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted(
        [
            (1, long_text), (2, "something else entirely " * 9), (-1, "no id at all here " * 9), (5, "a text of its own it is " * 9),
            (6, "left of two " * 9), (6, "right of both " * 9),
        ]
    )


def test_sizes_of_buckets_are_never_broadcast(spark, capsys, tmp_path):
    # A table this small would be broadcast by its estimate, which leaves out that every node has 31 places.
    spark.range(100).withColumnRenamed("id", "fp").write.parquet(str(tmp_path / "nodes"))
    for found in simhash.links(spark.read.parquet(str(tmp_path / "nodes"))):
        found.explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.first_of_each(df).count() == 0


def test_components_of_chains_rings_and_hubs(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, j) for j in range(201, 260)] + [(5, 5), (9, 3), (3, 9), (3, 1)]
    rng.shuffle(edges)
    found = {r.node: r.root for r in components.roots(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 100 for i in range(101, 141)} | {j: 200 for j in range(201, 260)} | {9: 1, 3: 1}
    assert found == want
