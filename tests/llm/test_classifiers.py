"""Language, toxicity and quality: held-out accuracy on the small tables, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.llm import language, quality, toxicity
from fotolake.llm.queries import op5_toxicity, op7_language, op9_quality

SF = "/root/testdata/sf0.01"


def edge(spark):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (3, "12 34 !?"), (None, "word " * 30_000), (4, "\n\n \n"), (5, "a\nb\nc" * 500)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as lang", "1 as score", "2 as label", "3 as id", "4 as at")


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op7_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    known = language.profiles(docs, 5, 0)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(edge(spark), known).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[None][0] in known
    assert language.predict(edge(spark).limit(0), known).collect() == []
    assert language.predict(edge(spark), {}).select("lang_pred").distinct().collect()[0][0] == "und"


def counted(rows, label):
    hit = sum(r.predicted == r[label] for r in rows)
    return hit / len(rows)


@pytest.mark.parametrize(("query", "label"), [(op5_toxicity, "toxic"), (op9_quality, "quality")])
def test_held_out(spark, query, label):
    rows = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", label).collect()
    assert counted(rows, label) > 0.9
    mean = lambda k: np.mean([r.score for r in rows if r[label] == k])
    assert mean(1) > mean(0) + 0.3 and all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None), (4, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    field, share = quality.train(docs, labels, 3, 1)
    weights, bias = toxicity.train(docs, labels, 4, 2)
    for found in (quality.score(edge(spark), field, share), toxicity.score(edge(spark), weights, bias)):
        rows = found.collect()
        assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(edge(spark).limit(0), field, share).collect() == []
    assert quality.train(docs, labels.limit(0), 3, 1) == (None, 1.0)
    assert toxicity.train(docs, labels.limit(0), 4, 2)[0] == {}
    assert quality.without_rejected(edge(spark), None, 1.0).count() == 7


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    unary, moves = rng.normal(size=7), rng.normal(size=(2, 2))
    lengths = np.array([4, 1, 2])
    got, pairs = quality.marginals(unary, lengths, moves)
    want, wanted_pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        total, good, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for bits in np.ndindex(*[2] * n):
            w = np.exp(sum(unary[at + i] * b for i, b in enumerate(bits)) + sum(moves[a, b] for a, b in zip(bits, bits[1:])))
            total, good = total + w, good + w * np.array(bits)
            for a, b in zip(bits, bits[1:]):
                pair[a, b] += w
        want += list(good / total)
        wanted_pairs += pair / total
        at += n
    assert np.allclose(got, want, atol=1e-6) and np.allclose(pairs, wanted_pairs, atol=1e-6)


def test_non_negative_risk_prefers_positive_words():
    rng = np.random.default_rng(2)
    background = lambda: sorted(set(rng.integers(1, 30, 8).tolist()))
    positive = [[0, *background()] for _ in range(200)]
    unlabelled = [[0, *background()] if rng.random() < 0.1 else background() for _ in range(800)]
    w, b = toxicity.fit(positive, lambda v: toxicity.sums(*toxicity._flat(unlabelled), v), 30, 0.1)
    assert w[0] + b > 0 > w[1:].max() + b


def test_quality_against_enumeration():
    """A document's score by enumerating all labellings of its lines, and the loss's gradient at the end of training."""
    rng = random.Random(5)
    good = ["\n".join(f"This is a whole sentence about subject {rng.randrange(99)}, and it ends." for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    bad = ["\n".join("BUY | NOW | !!! | " + str(rng.randrange(10**6)) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    chains = [quality.lines_of(t) for t in good + bad]
    field = quality.fit(quality.measures([x for c in chains for x in c]), np.array([len(c) for c in chains]), np.array([1] * 40 + [0] * 40))
    text = good[0].split("\n")[0] + "\n\n" + bad[0].split("\n")[0] + "\nmore | 1\n" + good[1].split("\n")[0]
    lines = quality.lines_of(text)
    n = len(lines)
    unary = field.unary(field.bins(quality.measures(lines)), np.arange(n) == 0, np.arange(n) == n - 1)
    total, sure = 0.0, np.zeros(n)
    for bits in np.ndindex(*[2] * n):
        w = np.exp(sum(unary[i] * b for i, b in enumerate(bits)) + sum(field.moves[a, b] for a, b in zip(bits, bits[1:])))
        total, sure = total + w, sure + w * np.array(bits)
    weight = np.array([len(x) for x in lines])
    assert abs(quality.score_texts(field, [text], 0.5)[0] - (sure / total * weight).sum() / weight.sum()) < 1e-6
    scores = quality.score_texts(field, good + bad, 0.5)
    assert scores[:40].min() > 0.5 > scores[40:].max()


def test_quality_bounds(spark, monkeypatch):
    """Chains are whole, and documents beyond the bounds of the sample are left out, not cut."""
    docs = spark.createDataFrame([(i, "\n".join([f"line {i} of some length."] * (5 + 40 * i))) for i in range(30)] + [(3, "zz")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda raw, lengths, good: seen.append((raw, lengths)) or quality.Field(np.zeros((13, 5)), np.zeros(0), np.zeros((2, 2)), 0.5))
    quality.train(docs, labels, 10**6, -1)
    assert sorted(seen[0][1].tolist()) == [5 + 40 * i for i in range(30)] and len(seen[0][0]) == seen[0][1].sum()
    quality.train(docs, labels, 10**6, -1, longest=500, most_lines=1500)
    assert seen[1][1].max() <= 500 and seen[1][1].sum() <= 1500 and set(seen[1][1].tolist()) <= {5 + 40 * i for i in range(30)}


def test_risk_against_finite_differences():
    """The step's direction is the gradient of the corrected risk, or of the bracket's opposite where that is negative."""
    rng = np.random.default_rng(4)
    rows = lambda n: [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(n)]
    positive, unlabelled, prior = rows(9), rows(25), 0.3

    def risk(w):
        f = lambda r: w[r].sum() + w[-1]
        neg = lambda some: np.mean([np.log1p(np.exp(f(r))) for r in some])
        bracket = neg(unlabelled) - prior * neg(positive)
        plain = bracket + prior * np.mean([np.log1p(np.exp(-f(r))) for r in positive]) if bracket >= 0 else -bracket
        return plain + toxicity.DECAY / 2 * (w[:-1] ** 2).sum()

    p, u = toxicity._flat(positive), toxicity._flat(unlabelled)
    seen = np.append(np.bincount(p[1], minlength=6), 9.0)
    sides = set()
    for scale in (0.5, 1.0, 6.0):
        w = rng.normal(size=7) * scale
        if scale == 6:
            w = np.where(np.bincount(p[1], minlength=6) / 9 > np.bincount(u[1], minlength=6) / 25, 6.0, -6.0)
            w = np.append(w, 4.0)
            prior = 0.9
        got = toxicity.risk_step(toxicity.sums(*p, w), seen, toxicity.sums(*u, w), w, prior)
        want = [(risk(w + e) - risk(w - e)) / 2e-6 for e in np.eye(7) * 1e-6]
        assert np.allclose(got, want, atol=1e-5)
        sides.add(bool(toxicity.sums(*u, w)[-2] / 25 < prior * toxicity.sums(*p, w)[-2] / 9))
    assert False in sides


def test_unlabelled_sums_cover_all_rows(spark):
    docs = spark.createDataFrame([(i, ("vile words here " if i % 10 == 0 else "mild words there ") + f"filler{i % 7}") for i in range(900)] + [(5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(0, 400, 5)], "doc_id long, toxic int")
    weights, bias = toxicity.train(docs, labels, 4, 2)
    found = {r.doc_id: r.score for r in toxicity.score(docs, weights, bias).collect()}
    assert min(found[i] for i in range(0, 900, 10)) > max(found[i] for i in range(1, 900) if i % 10)
    assert "vile" in weights and weights["vile"] > 0
    # Every unlabelled text counts, and as often as it is there: the same by a plain trainer over the texts themselves.
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    at = {x: i for i, x in enumerate(sorted(weights))}
    features = lambda t: sorted(at[x] for x in toxicity.words(t) & at.keys())
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    share = np.mean([r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    known = {i: min(t for j, t in rows if j == i) for i, _ in rows if i in toxic}
    flat = toxicity._flat([features(t) for _, t in rows])
    w, b = toxicity.fit([features(t) for t in known.values()], lambda v: toxicity.sums(*flat, v), len(at), share)
    assert np.allclose([weights[x] for x in sorted(at)], w, atol=1e-6) and abs(bias - b) < 1e-6
    times = np.array([3.0, 1.0])
    some = toxicity._flat([[0], [0, 1]])
    assert np.allclose(toxicity.sums(*some, np.array([0.5, -1.0, 0.2]), times), toxicity.sums(*toxicity._flat([[0]] * 3 + [[0, 1]]), np.array([0.5, -1.0, 0.2])))


def plain_grams(text, size):
    """The most frequent n-grams of a text by counting strings."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + " ".join(runs.split()) + " "
    found = {}
    for k in (1, 2, 3):
        for i in range(len(line) - k + 1):
            g = line[i : i + k]
            if g.strip() and not (k == 3 and g[1] == " "):
                found[g] = found.get(g, 0) + 1
    place = lambda g: [0] * (3 - len(g)) + [0x110000 if c == " " else ord(c) for c in g]
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], place(x[0])))][:size]


def test_language_against_plain_distances(spark):
    rng = random.Random(8)
    rare = "".join(map(chr, (0x30001, 0x31000, 0x20000)))
    bits = {"a": "the and of in to was that", "b": "der die und das nicht ein zu", "c": rare, "d": "και το της ΣΑΣ ὀδός"}
    made = [(lang, " ".join(rng.choices(list(words) if lang == "c" else words.split(), k=30))) for lang, words in bits.items() for _ in range(8)]
    rows = [(i, lang, text) for i, (lang, text) in enumerate(made)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    known = language.profiles(docs, 5, 0, size=60)
    learned = {}
    for lang in bits:
        all_of = [t for i, x, t in rows if x == lang and zlib.crc32(str(i).encode()) % 5]
        counts = {}
        for t in all_of:
            for g in plain_grams(t, 10**9):
                line = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
                counts[g] = counts.get(g, 0) + sum(line.startswith(g, i) for i in range(len(line)))
        place = lambda g: [0] * (3 - len(g)) + [0x110000 if c == " " else ord(c) for c in g]
        learned[lang] = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], place(x[0])))][:60]
    number = lambda g: sum((0x110000 if c == " " else ord(c)) << (21 * k) for k, c in enumerate(reversed(g)))
    assert {k: [number(g) for g in v] for k, v in learned.items()} == known
    tests = [t for _, _, t in rows] + [rare * 7, "the die και", "x", "", "\U00030001" * 20, "12 ٣ !"]
    found = language.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), known, size=60).collect()
    for r in found:
        own = plain_grams(tests[r.doc_id], 60)
        far = {k: sum(abs(v.index(g) - i) if g in v else 60 for i, g in enumerate(own)) for k, v in learned.items()}
        assert r.lang_pred == (min(sorted(far), key=far.get) if own else "und"), tests[r.doc_id]
    assert found[-2].lang_pred == "c" and found[-1].lang_pred == "und"


def test_letters_of_all_planes_are_letters():
    from fotolake.llm.quality import measures

    near, far, digit = measures(["\u4e00" * 20]), measures(["\U00020000" * 20]), measures(["\U0001d7d8" * 20])
    assert (near[0] == far[0]).all() and near[0][1] == 1 and digit[0][3] == 1
