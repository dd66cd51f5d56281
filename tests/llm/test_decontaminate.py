"""Leaks against a plain reading of the rules in Python, and planted cases."""

import random
import re

from fotolake.llm.decontaminate import NAME, NUMBER, UNIT, UNITS, contaminated, without_leaks


def template(text):
    typed = re.sub(r"""(?:(?<=[^\s.!?:]\s)|(?<=[^\s.!?:]\s["'(]))[A-ZÄÖÜ][a-zäöüß]+""", NAME, text or "")
    typed = re.sub(r"(?<![^\W_])[0-9]+(?:[.,:/][0-9]+)*", NUMBER, typed)
    typed = re.sub(rf"({NUMBER}(?:[^\w\s]|_){{0,4}}\s?)(?:{UNITS})(?![^\W_])", rf"\1{UNIT}", typed)
    clean = lambda s: re.sub(rf"[^\w\s{NAME}{NUMBER}{UNIT}]|_", "", s).lower().split()
    t, v = clean(typed), clean(text or "")
    slot = set(NAME + NUMBER + UNIT)
    by_value, placed, i = list(t), list(t), 0
    while i < len(t):
        j = i
        while j < len(t) and set(t[j]) <= slot:
            j += 1
        if j - i >= 4 or (j - i == len(t) and j > i):
            by_value[i:j] = v[i:j]
        if j - i >= 4:
            placed[i:j] = [f"{w}{k}/{j - i}" for k, w in enumerate(t[i:j])]
        i = max(j, i + 1)
    plain = [x if NAME in w else w for w, x in zip(by_value, v, strict=True)]
    return t, v, [by_value, plain, placed]


def brute(docs, items, window=8, coverage=0.3):
    """All windows of all templates, all places: no repeats left out, no table of runs."""
    out, seed = {}, window // 2
    for item, source in items:
        t, v, forms = template(source)
        if not t:
            continue
        size = min(window, len(t))
        n = len(t) - size + 1
        slots = {i for i, w in enumerate(t) if set(w) & set(NAME + NUMBER + UNIT)}
        for doc, text in docs:
            dt, dv, other = template(text)
            short = min(seed, len(t))
            run = lambda i, j, w: any(d[i : i + w] == f[j : j + w] for d in other for f in forms)
            hits = {}
            for i in range(len(dt) - size + 1):
                for j in range(n):
                    if run(i, j, short) and run(i + size - short, j + size - short, short):
                        hits.setdefault(i - j, set()).add(j)
            for offset, places in hits.items():
                pairs = {(v[j + k], dv[offset + j + k]) for j in places for k in range(size) if (j + k) in slots}
                if len({a for a, _ in pairs}) == len(pairs) and len(places) >= coverage * n:
                    whole = slots <= {j + k for j in places for k in range(size)}
                    new = (len(places), whole and all(a == b for a, b in pairs))
                    out[doc, item] = max(out.get((doc, item), new), new)
    return {k: (n, "exact" if e else "reparameterised") for k, (n, e) in out.items()}


ITEM = "A train leaves at 12:30 with 40 kg of coal and meets Anna after 3 hours, then Anna adds 40 kg more and rides on."


def test_planted_and_brute_force(spark):
    rng = random.Random(5)
    words = "alpha beta gamma Delta epsilon zeta, eta 7 km theta; iota 12.5 Kappa".split()
    items = [(0, ITEM), (1, " ".join(rng.choices(words, k=30))), (2, "too short"), (3, None)]
    noise = lambda k: " ".join(rng.choices(words, k=k))
    docs = [(1, noise(20) + ". " + ITEM + " " + noise(9)), (2, ITEM.replace("40", "55").replace("Anna", "Berta").replace("12:30", "9")), (3, ITEM.replace("40", "55", 1)), (4, None), (5, ""), (6, noise(400)), (7, " ".join(w + "***" for w in ITEM.split())), (8, "x " + ITEM[:70] + " y"), (8, noise(30)), (9, items[1][1]), (None, ITEM), (10, (ITEM + " ") * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as h", "3 as slots", "4 as id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.kind) for r in contaminated(df, bench).collect()}
    assert got == brute(docs, items)
    assert got[1, 0][1] == got[7, 0][1] == "exact" and got[2, 0][1] == "reparameterised" and (3, 0) not in got
    left = sorted(map(repr, ((r.doc_id, r.text) for r in without_leaks(df, bench).collect())))
    leaks = {i for i, _ in brute([(i, t) for i, (_, t) in enumerate(docs)], items)}
    assert left == sorted(map(repr, (d for i, d in enumerate(docs) if i not in leaks)))
    assert contaminated(df.limit(0), bench).collect() == contaminated(df, bench.limit(0)).collect() == []


def found(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}


PLAIN = "a farmer brings some corn to the mill and asks how many bags of flour it will give him before winter"


def test_lightly_edited_copies(spark):
    """Inserted and substituted words; other texts and texts of the item's words in another order stay clear."""
    rng = random.Random(8)
    docs = []
    for edits in (1, 2, 3):
        for _ in range(10):
            more, other = PLAIN.split(), PLAIN.split()
            for at in sorted(rng.sample(range(1, 20), edits), reverse=True):
                more.insert(at, "really")
            for at in (rng.choice((0, 5, 6)), 10, 16)[:edits]:
                other[at] = "rather"
            docs += [(len(docs) + i, f"some words before {' '.join(w)} and some after it") for i, w in enumerate((more, other))]
    shuffled = PLAIN.split()
    rng.shuffle(shuffled)
    docs += [(900, " ".join(shuffled)), (901, "the mill and asks how many people come to see it before noon or after dark in the long summer")]
    got = found(spark, docs, [(0, PLAIN)])
    # Three inserted words may leave too little of a text of 20.
    assert [d for d, _ in docs[:40] if (d, 0) not in got] == [] and sum((d, 0) not in got for d, _ in docs[40:60]) <= 6
    assert (900, 0) not in got and (901, 0) not in got


def test_longer_names(spark):
    got = found(spark, [(1, ITEM.replace("Anna", "Berta Maria")), (2, ITEM.replace("Anna", "Anna Maria").replace("40", "70"))], [(0, ITEM)])
    assert got.keys() == {(1, 0), (2, 0)} and got[2, 0].kind == "reparameterised"


SENTENCES = "The mill is old. Seven men work there by day. Their wives bake bread at home. None of them owns a horse. They walk to town. Nobody rides."


def test_names_do_not_hang_on_signs(spark):
    docs = [SENTENCES.replace(".", ""), SENTENCES.replace(".", ","), SENTENCES.replace(".", ".***"), SENTENCES.lower(), SENTENCES.upper(), SENTENCES.replace("mill", "Mill")]
    got = found(spark, list(enumerate(docs)), [(0, SENTENCES)])
    assert {k: r.kind for k, r in got.items()} == {(i, 0): "exact" for i in range(len(docs))}
    assert all(got[i, 0].coverage == 1 for i in range(5))


def test_one_value_for_two_and_contradictions(spark):
    item = "Take 3 apples and 5 pears out of the bowl beside the stove and say how much of the fruit is left"
    long = item + " when 3 more guests come along the road from the far end of the valley with empty bags and large hopes"
    docs = [(1, item.replace("3", "4").replace("5", "4")), (2, long.replace("3", "8", 1)), (3, item.replace("3", "8")), (3, item.replace("3", "9")), (4, "x " + item.replace("3", "8")), (4, "y " + item)]
    got = found(spark, docs, [(0, item), (1, long)])
    assert {d for d, i in got if i == 0} == {1, 2, 3, 4} and got[1, 0].kind == got[3, 0].kind == "reparameterised" and got[1, 0].coverage == 1
    # Windows with the contradicted value do not count.
    assert (2, 1) in got and 0.3 <= got[2, 1].coverage < 1


def test_tables_of_figures_and_repeats(spark):
    """Texts of placeholders or repeats alone: found by their values, in memory that follows their length."""
    rng = random.Random(13)
    figures = [str(rng.randrange(10**6)) for _ in range(20_000)]
    item = " ".join(figures[7000:7200])
    docs = [(1, " ".join(figures)), (2, " ".join(str(rng.randrange(10**6)) for _ in range(20_000))), (3, "7 " * 20_000), (4, "7 8 " * 10_000), (5, item.replace(" ", ", "))]
    got = found(spark, docs, [(0, item), (1, "7 " * 200), (2, " ".join(f"row {i}" for i in range(100)))])
    # Repetitions of more than sixteen periods count as that long.
    assert {k: r.kind for k, r in got.items()} == {(1, 0): "exact", (5, 0): "exact", (3, 1): "exact"}
    rows = [(1, " ".join(f"row {i}" for i in range(3000)))]
    assert found(spark, rows, [(2, " ".join(f"row {i}" for i in range(50, 80)))])[1, 2].kind == "exact"


def test_short_items(spark):
    items = [(0, "How far is old Utrecht"), (1, "Utrecht"), (2, "only 3 words")]
    docs = [(1, "He asks: how far is old Leiden, then? " + PLAIN), (2, "how far is it to old Utrecht " + PLAIN), (3, "Utrecht!"), (4, "utrecht and more"), (5, "only 4 words"), (6, "there are only 3 words here")]
    assert {k: r.kind for k, r in found(spark, docs, items).items()} == {(1, 0): "reparameterised", (2, 1): "exact", (3, 1): "exact", (4, 1): "exact", (5, 2): "reparameterised", (6, 2): "exact"}


def test_periodic_items(spark):
    """A short period is no reason to miss a copy, in a text or as one."""
    steps = "go left go right " * 6
    docs = [(1, f"he said {steps}and stopped at the gate"), (2, steps), (3, "go left go right"), (4, "turn " * 300 + "back home now please and wait there"), (5, "go left go right go left then rest")]
    got = found(spark, docs, [(0, steps), (1, "turn " * 40 + "back home now please and wait there")])
    assert {k: r.kind for k, r in got.items()} == {(1, 0): "exact", (2, 0): "exact", (4, 1): "exact"}


def test_rows_of_placeholders_with_other_values(spark):
    items = [(0, "the vector 1 2 3 4 times the vector 5 6 7 8 gives which value in total"), (1, "the mean of values 3 5 8 13 21 34 is what number"), (2, "3 + 4 + 5 + 6"), (3, "then Anna Maria Lopez Garcia went to the mill with her old friends")]
    docs = [(0, "say the vector 9 2 7 1 times the vector 6 5 3 4 gives which value in total now"), (1, "the mean of values 2 9 4 1 7 30 is what number"), (2, "7 + 1 + 9 + 2"), (3, "then Berta Julia Perez Ruiz went to the mill with her old friends")]
    docs += [(i + 10, t) for i, t in items] + [(20, "a list 7 1 9 2 of figures in some text"), (21, "a list 3 4 5 6 of figures in some text"), (22, "the mean of values 2 9 4 1 is what they see")]
    got = {k: r.kind for k, r in found(spark, docs, items).items()}
    assert got == {(i, i): "reparameterised" for i in range(4)} | {(i + 10, i): "exact" for i in range(4)} | {(21, 2): "exact"}


def test_many_items_by_shuffle(spark, monkeypatch):
    """Beyond the bound of a broadcast the same rows come by shuffle, with rows as narrow for a text of 20,000 words."""
    from fotolake.llm import decontaminate

    rng = random.Random(14)
    docs = [(i, f"before {ITEM.replace('40', '70')} after") for i in range(3)] + [(9, " ".join(rng.choices(PLAIN.split(), k=20_000)) + " " + PLAIN)]
    want = found(spark, docs, [(0, ITEM), (1, PLAIN)])
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    got = found(spark, docs, [(0, ITEM), (1, PLAIN)])
    assert got == want and (9, 1) in got and (2, 0) in got


def test_rows_without_ids_and_rows_that_share_one(spark):
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    rows = [(None, ITEM, 1), (None, "clean", 2), (4, ITEM, 3), (4, "clean too", 4), (5, None, 5), (6, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.key` int")
    assert sorted(r["a.key"] for r in without_leaks(docs, bench).collect()) == [2, 4, 5, 6]
