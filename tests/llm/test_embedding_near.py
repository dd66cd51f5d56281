"""Links against all cosines, in double precision."""

import numpy as np

from fotolake.llm.embedding_near import embedding_components, threshold


def brute(rows, cosine):
    ok = [label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, label, v in rows]
    comp, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, (_, a, u) in enumerate(rows):
        for j, (_, b, v) in enumerate(rows[:i]):
            if ok[i] and ok[j] and a == b and len(u) == len(v):
                x, y = np.array(u, float), np.array(v, float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    comp[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return {r[0]: (links[i], least.get(top(i))) for i, r in enumerate(rows)}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        base = rng.standard_normal(24)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), int(k % 3), (base + rng.standard_normal(24) * rng.choice([0, 0.02, 0.1, 0.18])).astype(np.float32).tolist()))
    first = rows[0][2]
    rows += [(1000, 0, None), (1001, 0, []), (1002, 0, [0.0] * 24), (1003, 0, [None, *first[1:]]), (1004, 0, [float("nan"), *first[1:]]), (1005, None, first), (1006, 0, [3 * x for x in first]), (1007, 0, first[:5]), (1008, 0, [float("inf"), *first[1:]])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as node", "2 as vec", "3 as n_links", "4 as id")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(df).collect()}
    want = brute([(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows], 0.98)
    assert set(got) == set(want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values()) > 0
    assert all(got[i][0] <= want[i][0] and got[i][1] >= want[i][1] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_copies_and_empty(spark):
    v = np.random.default_rng(0).standard_normal(8).tolist()
    df = spark.createDataFrame([(i, 1, v) for i in range(5, 55)], "vec_id long, label int, embedding array<float>")
    assert {(r.n_links, r.component_id, r.kept == (r.vec_id == 5)) for r in embedding_components(df).collect()} == {(49, 5, True)}
    assert embedding_components(df.limit(0)).collect() == []


def test_threshold_falls_with_recall():
    assert 0 < threshold(0.999) <= threshold(0.9) < 32


def test_collisions_against_plain_counts():
    from fotolake.llm.embedding_near import DIRECTIONS, collisions

    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(40, DIRECTIONS)), rng.normal(size=(70, DIRECTIONS))
    b[:20] = a[:20] + rng.normal(size=(20, DIRECTIONS)) * 0.2
    counts = (np.abs(a[:, None] - b[None]) <= 0.4).sum(axis=2)
    for least in (0, 3, 9, 20, 32):
        assert set(zip(*collisions(a, b, 0.4, least), strict=True)) == set(zip(*np.nonzero(counts >= least), strict=True))


def test_recall_of_planted_pairs(spark):
    """Pairs at cosines from 0.98 to 0.999, the most of them at the threshold itself."""
    rng = np.random.default_rng(6)
    rows, dim, n = [], 64, 1500
    for i in range(n):
        u = rng.standard_normal(dim)
        u /= np.linalg.norm(u)
        w = rng.standard_normal(dim)
        w -= (w @ u) * u
        c = 0.9802 if i % 3 else rng.uniform(0.98, 0.999)
        v = c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w)
        rows += [(2 * i, i % 2, u.tolist()), (2 * i + 1, i % 2, v.tolist())]
    got = embedding_components(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.98 * 2 * n
    assert all(r.component_id in (r.vec_id, r.vec_id - 1) and r.n_links <= 1 for r in got)


def test_repeated_and_null_ids_beyond_the_bound(spark, monkeypatch):
    from fotolake.llm import embedding_near

    v, w = np.eye(8)[0].tolist(), np.eye(8)[1].tolist()
    rows = [(5, 1, v), (5, 1, v), (None, 1, v), (3, 1, [2 * x for x in v]), (None, 1, w), (7, 1, w), (7, 2, w), (None, 2, [0.0] * 8)]
    want = sorted(map(repr, [(5, 3, 3, False), (5, 3, 3, False), (None, 3, 3, False), (3, 3, 3, True), (None, 1, 7, False), (7, 1, 7, True), (7, 0, 7, True), (None, 0, None, True)]))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for bound in (embedding_near.BROADCAST_CELLS, 0):
        monkeypatch.setattr(embedding_near, "BROADCAST_CELLS", bound)
        assert sorted(repr(tuple(r)) for r in embedding_components(df).collect()) == want
