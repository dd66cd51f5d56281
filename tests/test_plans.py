"""Rewritten plans against plain loops: lens choice, names of exports, runs in time, hierarchies, relinking, new ids."""

import random

from fotolake.operators import catalog, lens, people, planning, stacks, stats


def plain_words(name):
    import re

    low = name.lower().replace("f/", "f ").replace("ƒ", "f")
    out = set()
    for w in re.findall(r"[0-9][0-9.]*|[^\W\d_]+", low):
        w = w.rstrip("0").rstrip(".") if "." in w else w
        if w not in ("mm", "f"):
            out.add(w)
    return out


def test_lens_choice(spark):
    rng = random.Random(2)
    ranges = [("24-105", 24.0, 105.0), ("24.04-105", 24.04, 105.0), ("50", 50.0, 50.0), ("70-200", 70.0, 200.0)]
    names = lambda n: [(f"{rng.choice(['Canon EF', 'Sigma', 'Tamron SP', 'EF', 'Canon RF'])} {r[0]}mm f/{rng.choice(['2.8', '4', '2.80'])} {' '.join(rng.sample(['L', 'IS', 'II', 'USM', 'DG', 'HSM', 'Art'], rng.randrange(4)))}".strip(), r) for r in (rng.choice(ranges) for _ in range(n))]
    lenses = [(n, rng.choice([1.0, 1.5, 1.6]), i, r) for i, (n, r) in enumerate(dict(names(80)).items())]
    lenses += [("Solo 13-14mm", 1.0, 900, ("", 13.0, 14.0))]
    shots = [(i, n, rng.choice([1.0, 1.5]), r) for i, (n, r) in enumerate(names(60))] + [(100, "EF24-105mm f/4 L", 1.5, ranges[0]), (101, "13.0-14.0 mm", 1.5, ("", 13.0, 14.0)), (102, "24-105 mm", 1.5, ranges[0]), (103, "no focal", 1.0, None)]
    want = {}
    for i, name, crop, r in shots:
        if r is None:
            continue
        spaced = "Canon EF 24-105mm f/4 L" if i == 100 else name
        w = plain_words(spaced)
        fits = [(n, at) for n, c, at, q in lenses if crop / c >= 0.96 and abs(q[1] - r[1]) <= 0.05 and abs(q[2] - r[2]) <= 0.05]
        if all(x.replace(".", "").isdigit() for x in w):
            if len(fits) == 1:
                want[i] = fits[0][0]
            continue
        best = 0.7
        for n, _ in fits:
            v = plain_words(n)
            score = len(w & v) / max(1, len(w | v)) + 0.5 * len(w & v) / max(1, len(w))
            if score > best + 1e-12:
                best, want[i] = score, n
    got = lens.find(spark.createDataFrame([s[:3] for s in shots], "shot int, name string, crop double"), spark.createDataFrame([x[:3] for x in lenses], "lens string, crop double, at int"), "at").collect()
    assert {r.shot: r.lens for r in got} == want and 101 in want and 102 not in want and len(want) > 30


def test_export_names_one_by_one(spark):
    rng = random.Random(4)
    on_disk = {f"/o/{s}{n}.jpg" for s in "ab" for n in ("", "-2", "-4", "-5", "-9") if rng.random() < 0.8}
    items = [(i, "/o", rng.choice(["a", "b", "c", "a-3", "c-2"]), "jpg", i) for i in range(60)]
    plain = {f"/o/{s}.jpg" for _, _, s, _, _ in items}
    want, taken = {}, set(on_disk)
    for i, d, s, e, _ in items:
        n = 1
        while True:
            path = f"{d}/{s}{'' if n == 1 else f'-{n}'}.{e}"
            if path not in taken and (n == 1 or path not in plain):
                break
            n += 1
        taken.add(path)
        want[i] = path
    got = planning.export_paths(spark.createDataFrame(items, "id int, dir string, stem string, ext string, seq int"), spark.createDataFrame([(p,) for p in on_disk], "path string")).collect()
    assert {r.id: r.out_path for r in got} == want


def test_runs_over_ranges(spark):
    rng = random.Random(5)
    rows = [(i, f"2024-01-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}" if i % 9 else None, 0, None if i % 13 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, capture_time string, stack_id long, master long").repartition(7)
    at = sorted((int(t[11:13]) * 3600 + int(t[14:16]) * 60 + int(t[17:]), i) for i, t, _, m in rows if t and m is None)
    runs, want = [], {}
    for t, i in at:
        if runs and t - runs[-1][-1][0] <= 120:
            runs[-1].append((t, i))
        else:
            runs.append([(t, i)])
    for run in runs:
        if len(run) > 1:
            want |= {i: (run[0][1], k) for k, (_, i) in enumerate(run)}
    assert {r.id: (r.stack_id, r.stack_pos) for r in stacks.auto_stack(df, 120).collect()} == want and len(want) > 50
    assert stacks.auto_stack(df.limit(0), 120).collect() == []


def test_deep_hierarchy(spark):
    nodes = spark.createDataFrame([(i, f"n{i}", i - 1 if i else None) for i in range(50)] + [(90, "x", 91), (91, "y", 90)], "id int, name string, parent int")
    got = {r.id: (r.depth, r.path) for r in catalog.hierarchy(spark, nodes).collect()}
    assert len(got) == 50 and got[49] == (50, "/".join(f"n{i}" for i in range(50)))


def test_relink(spark):
    files = [("/b/x.jpg", 5), ("/a/x.jpg", 7), ("/c/X.JPG", 5), ("/d/y.jpg", 1)]
    photos = [(1, "/old/x.jpg", "x.jpg", 5, True, None), (2, "/old/x.jpg", "x.jpg", 0, True, None), (3, "/old/x.jpg", "x.jpg", 6, True, None), (4, "/old/z.jpg", "z.jpg", 1, True, None), (5, "/old/y.jpg", "y.jpg", 1, True, 1), (6, "/old/y.jpg", "Y.jpg", 1, False, None)]
    df = spark.createDataFrame(photos, "id int, path string, file_name string, file_size long, missing boolean, master int")
    got = planning.relink(df, spark.createDataFrame(files, "path string, size long")).collect()
    assert {r.id: r.new_path for r in got} == {1: "/b/x.jpg", 2: "/a/x.jpg", 3: "/a/x.jpg"}


def test_new_persons_and_words(spark):
    faces = spark.createDataFrame([(i, 0) for i in range(6)], "face_id long, person long")
    changes = spark.createDataFrame([(0, people.NEW_BASE + 3), (1, people.NEW_BASE + 3), (2, people.NEW_BASE), (3, 7)], "face_id long, person long")
    out, persons = people.apply_groups(faces, spark.createDataFrame([(7, "seven"), (4, "gone")], "id long, name string"), changes)
    assert {r.face_id: r.person for r in out.collect()} == {0: 9, 1: 9, 2: 8, 3: 7, 4: 0, 5: 0}
    assert sorted(r.id for r in persons.collect()) == [7, 8, 9]


def test_many_words_at_once(spark, monkeypatch):
    monkeypatch.setattr(catalog, "WORDS_AT_ONCE", 3)
    links = spark.createDataFrame([(1, "Word1")], "photo_id long, keyword string")
    words = spark.createDataFrame([(f"word{i}",) for i in range(10)], "keyword string")
    got = catalog.add_keywords(links, spark.createDataFrame([(1,), (2,)], "photo_id long"), words).collect()
    assert sorted((r.photo_id, r.keyword) for r in got) == sorted((p, "Word1" if i == 1 else f"word{i}") for p in (1, 2) for i in range(10))


def test_auto_tone_adds_to_present_settings(spark):
    hist = spark.createDataFrame([(k, b, 10) for k in (1, 2) for b in range(60, 200)], "image int, bin int, n int")
    present = spark.createDataFrame([(1, 1.5, 30.0)], "image int, exposure double, vibrance double")
    got = {r.image: r for r in stats.auto_tone(hist, ["image"], present).collect()}
    assert abs(got[1].exposure - got[2].exposure - 1.5) < 0.011 and (got[1].vibrance, got[2].vibrance) == (30.0, 10.0)
