"""SimHash against brute force: bits by bit, pairs by pairs."""

import random

import pytest
import xxhash

from fotolake.llm.simhash import simhash_components


def brute(rows, words, radius):
    prints = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        parts = [p.decode() for p in low.encode().split()]
        grams = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                comp[top(i)] = top(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[top(i)] = min(ids.get(top(i), doc), doc)
    return sorted((repr(doc), f"{p:016x}", ids.get(top(i))) for i, ((doc, _), p) in enumerate(zip(rows, prints, strict=True)))


@pytest.mark.parametrize("radius", [4, 16])
def test_against_brute_force(spark, radius):
    rng = random.Random(7)
    vocabulary = ["Alpha", "beta", "gÄmma", "delta", "EPSILON", "z", "Keta", "ta ta", "theta"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 9, 60])))) for i in range(60)]
    for i in range(40):
        parts = rng.choice(rows)[1].split(" ")
        parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
        rows.append((100 + i, "\t\n ".join(parts)))
    rows += [(200, None), (201, ""), (202, " \x0b "), (None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1]), (203, "w " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fingerprint", "2 as component_id", "'x' as id")
    got = simhash_components(docs, words=4, radius=radius).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in got) == brute(rows, 4, radius)


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_wide_prints_find_edited_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))) for i in range(20)]
    rows += [(100 + i, " ".join(base[: 50 + i] + ["edit"] + base[51 + i :])) for i in range(10)]
    got = {r.doc_id: r.component_id for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), width=4, radius=41).collect()}
    assert all(got[100 + i] == 100 for i in range(10)) and all(got[i] == i for i in range(20))


def test_similarity_is_exact(spark):
    rng = random.Random(9)
    rows, sets = [], []
    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(6):
            text = base[:]
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    rows.append((5, rows[5][1]))
    for _, t in rows:
        p = t.split()
        sets.append({tuple(p[i : i + 5]) for i in range(len(p) - 4)})
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                comp[max(top(i), top(j))] = min(top(i), top(j))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_components(docs, width=4, radius=52, similarity=0.8).collect()}
    assert sum(got[d] == rows[top(i)][0] for i, (d, _) in enumerate(rows)) >= len(rows) - 3
    assert all(got[d] >= rows[top(i)][0] for i, (d, _) in enumerate(rows))


def test_blocks_of_one_group(spark, monkeypatch):
    import fotolake.llm.simhash as module

    monkeypatch.setattr(module, "TEXTS", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], "edit", *base[i + 1 :]])) for i in range(0, 180, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in simhash_components(docs, width=4, radius=52, similarity=0.8).collect()} == {0}


def test_parts_of_one_group(spark, monkeypatch):
    """A candidate component of many blocks, of copies around one text, chains away from it and texts only nearly like them."""
    import fotolake.llm.simhash as module

    monkeypatch.setattr(module, "TEXTS", 4)
    monkeypatch.setattr(module, "REPRESENTATIVES", 2)
    rng = random.Random(17)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for _ in range(30):
        copy = base[:]
        copy[rng.randrange(160)] = f"e{rng.randrange(10**6)}"
        texts.append(copy)
    for chain in range(3):
        at = base[:]
        for step in range(12):
            for k in range(3 if chain < 2 else 5):
                at = at[:]
                at[(chain * 50 + step * 12 + k * 5) % 160] = f"c{chain}-{step}-{k}"
            texts.append(at)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_components(docs, width=4, radius=80, similarity=0.8).collect()}
    assert [got[i] for i in range(len(rows))] == root and 1 < len(set(root)) < len(rows)
    monkeypatch.setattr(module, "TEXTS", 512)
    assert got == {r.doc_id: r.component_id for r in simhash_components(docs, width=4, radius=80, similarity=0.8).collect()}


def test_blocks_cover_the_radius():
    from fotolake.llm.simhash import blocks

    rng = random.Random(1)
    for radius in (0, 4, 52):
        sizes = {p: rng.randrange(4000) for p in range(100, 150) if rng.random() < 0.8}
        first, splits, low, high = blocks(sizes, 256, radius)
        for p in sizes:
            for q in sizes:
                if abs(p - q) <= radius:
                    assert low[p] <= first[q] and first[q] + splits[q] - 1 <= high[p]
        assert all(low[p] <= first[p] <= high[p] for p in range(257))


def test_no_similar_pair_is_missed(spark):
    """Short texts, repeated lines and edits under the pipeline's parameters: each pair, alone, is a component if and only if similar."""
    import corpus_pipeline as c

    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    edits = [lambda w: w[:-1], lambda w: [*w, *fresh(1)], lambda w: [*fresh(1), *w[1:]], lambda w: [*w[: len(w) // 2], *fresh(1), *w[len(w) // 2 + 1 :]]]
    repeats = [lambda w, k=k: w + w[40:60] * k for k in (3, 5, 10)] + [lambda w, k=k: w[:-k] + fresh(k) for k in (11, 22)]
    pairs = [(w, edit(w)) for _ in range(15) for sizes, kinds in (((5, 6, 8, 9, 12, 13, 30, 200), edits), ((204,), repeats)) for n in sizes for edit in kinds for w in [fresh(n)]]
    grams = lambda p: {tuple(p[i : i + 5]) for i in range(len(p) - 4)} or {tuple(p)}
    rows = [(2 * i + j, " ".join(t)) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = {r.doc_id: r.component_id for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), words=c.WORDS, radius=c.RADIUS, width=c.WIDTH, similarity=c.SIMILARITY).collect()}
    for i, (a, b) in enumerate(pairs):
        similar = len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))
        assert got[2 * i + 1] == 2 * i + (not similar), (len(a), len(b))


def test_only_sizes_of_the_ratio_are_compared(monkeypatch):
    """Links by brute force between blocks and within one, and of the tiles no more than sizes allow."""
    import numpy as np

    import fotolake.llm.simhash as module

    monkeypatch.setattr(module, "TILE", 16)
    rng = np.random.default_rng(23)
    f = rng.integers(0, 2**63, (800, 4)).view(np.uint64)
    size = np.exp(rng.uniform(0, 9, 800)).astype(np.int64)
    for i in range(0, 400, 2):
        f[i + 1] = f[i] ^ np.uint64(1 << (i % 60))
        size[i + 1] = size[i] * rng.choice([0.7, 0.8, 0.9, 1.0, 1.25, 1.3])
    size[:6] = [4, 5, 5, 4, 3, 4]
    count, seen = np.bitwise_count, []
    monkeypatch.setattr(np, "bitwise_count", lambda x: seen.append(x.size) or count(x))
    order = rng.permutation(800)
    f, size = f[order], size[order]
    apart = np.array([count(f ^ x).sum(axis=1) for x in f])
    want = (apart <= 80) & (np.minimum(size, size[:, None]) >= 0.8 * np.maximum(size, size[:, None]) - 1e-6)
    same = lambda root: (root[:, None] == root[None, :]) == want  # noqa: E731 (planted pairs are apart from each other)
    assert same(module.linked(f, None, 80, size, ratio=0.8)).all() and 850 < want.sum() < 1200
    within, between = sum(seen), want[:300, 300:]
    root = module.linked(f[:300], f[300:], 80, size[:300], size[300:], 0.8)
    assert ((root[:300, None] == root[None, 300:]) == between).all() and between.any()
    assert within < 4 * 800 * 801 / 2 * 0.3


def test_sizes_within_the_ratio_meet(spark):
    """Equal fingerprints of other sizes are compared like any; pairs just at the ratio are found."""
    from fotolake.llm.simhash import near

    rows = [(i, 7, 7, 7, 7, size) for i, size in enumerate([0, 1, 4, 5, 9, 100, 125, 126, 10**6, 800_000])]
    got = {r.size: r.component_id for r in near(spark.createDataFrame(rows, "id long, f0 long, f1 long, f2 long, f3 long, size long"), 4, 0, ratio=0.8).collect()}
    assert got == {0: 0, 1: 1, 4: 2, 5: 2, 9: 4, 100: 5, 125: 5, 126: 5, 10**6: 8, 800_000: 8}
