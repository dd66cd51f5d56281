"""Quality rules: counts against regular expressions, the model against one of plain dictionaries, bands on planted texts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fotolake.llm import perplexity
from fotolake.llm.perplexity import Hashed, base, counts, discounts, distinct, model, quality_rules, repeated_words, streams

SCHEMA = "doc_id long, text string, lang string, bits long, key string, n_words string"


def rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def random_text(rng, n):
    return "".join(rng.choice(["a ", "b ", "the ", "\n", "\t", " ", "é", "日", "\x0b", "\x1c", "\xa0", "#", "<", "|x ", "𝄞", "\n\n", "a\n"]) for _ in range(n))


def test_counts_against_regular_expressions(monkeypatch):
    rng = random.Random(1)
    some = ["", " ", "\n \n \n", "a b c a b c", "a a a a", "x\r\nx\r\n", *(random_text(rng, rng.randint(0, 200)) for _ in range(300))]
    for piece in (1 << 20, 3):
        monkeypatch.setattr(perplexity, "PIECE", piece)
        assert [base(t) for t in some] == [rules(t) for t in some]
    ids = np.array([rng.randrange(4) for _ in range(500)])
    assert repeated_words(ids, 4) == repeated_words(ids, 1 << 21)


def plain(text):
    text = re.sub("[\t-\r ]+", " ", text)
    return "\n" * 4 + re.sub("[0-9]", "0", text)


class Brute:
    """Modified Kneser-Ney of characters, by dictionaries."""

    def __init__(self, corpus):
        c = {5: Counter(t[i - 4 : i + 1] for t in map(plain, corpus) for i in range(4, len(t)))}
        for k in (4, 3, 2, 1):
            c[k] = Counter(g[1:] for g in c[k + 1])
        self.c, self.d, self.all, self.left = c, {}, {}, {}
        for k in c:
            n = Counter(c[k].values())
            self.d[k] = discounts(n[1], n[2], n[3], n[4])
            self.all[k], self.left[k] = Counter(), defaultdict(float)
            for g, m in c[k].items():
                self.all[k][g[:-1]] += m
                self.left[k][g[:-1]] += self.d[k][min(m, 3) - 1]

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.c[1]) + 1)
        low, total = self.p(gram[1:]), self.all[k][gram[:-1]]
        if not total:
            return low
        m = self.c[k][gram]
        return ((m - self.d[k][min(m, 3) - 1] if m else 0) + self.left[k][gram[:-1]] * low) / total

    def bits(self, text):
        t = plain(text)
        return -sum(math.log2(self.p(t[i - 4 : i + 1])) for i in range(4, len(t)))


def corpus(rng, n=150):
    parts = ["tion", "the", "er", "on", "an", "re", "ing", "st", "ha", "wh", "e", "o", "a", "é", "日"]
    return [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(50, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    rows = [(i, t, rng.choice(["en", "de"]), 1, "clash", "x") for i, t in enumerate(corpus(rng))]
    rows += [(1000, None, "en", 1, None, None), (1001, "", None, 1, None, None), (1002, "few words", "xx", 1, None, None), rows[0], (None, rows[1][1], None, 1, None, None), (1003, " ".join(f"{a} same words" for a in "ab" * 90), "en", 1, None, None)]
    letters = [chr(c) for c in range(0x21, 0x7F)]
    rows += [(2000 + i, " ".join("".join(rng.choices(letters, k=9)) for _ in range(60)), "en", 1, None, None) for i in range(3)]
    rows += [(3000 + i, "\n".join(f"{'e' * 30} {i}{j} e" for j in range(60)), "de", 1, None, None) for i in range(3)]
    rows += [(4000, "the tion 12 " * 20_000, "en", 1, None, None)]
    return rows


def test_bits_against_brute_force_and_bands(spark, docs):
    got = quality_rules(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(got) == len(docs)
    brute, by = Brute([d[1] or "" for d in docs]), defaultdict(list)
    assert abs(sum(brute.p("tion"[:4] + w) for w in brute.c[1]) + brute.p("tion☃") - 1) < 1e-9
    for r in got:
        by[r.doc_id].append(r)
    for i, text, *_ in docs:
        text = text or ""
        for r in by[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rules(text)
            assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
            assert not (r.base_failed and r.kept)
            assert r.bits_per_char == pytest.approx(brute.bits(text) / max(1, len(plain(text)) - 4), abs=1e-4)
    assert all(r.kept for i in range(150) for r in by[i]) and by[None][0].kept
    assert not any(r.kept or r.base_failed for i in (2000, 2001, 2002) for r in by[i])
    assert not any(r.kept for i in (1000, 1001, 1002, 1003, 3000, 3001, 3002, 4000) for r in by[i])


def test_pieces_of_the_model_give_the_same(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, SCHEMA)
    want = sorted(map(repr, quality_rules(df).collect()))
    monkeypatch.setattr(perplexity, "PIECE", 97)
    n = model(counts(df))[0].count()
    assert sorted(map(repr, quality_rules(df, most=n // 3).collect())) == want


def test_unseen_characters_back_off(spark, docs):
    train = [d for d in docs if d[0] is not None and d[0] < 150]
    entries, unseen = model(counts(spark.createDataFrame(train, SCHEMA)))
    new = [(1, "tion ☃ theé 日x" * 30, "en", 1, None, None)]
    row = perplexity.scored(spark.createDataFrame(new, SCHEMA), entries, unseen).first()
    assert row.bits / 2**20 == pytest.approx(Brute([d[1] for d in train]).bits(new[0][1]), rel=1e-4)


def test_any_alphabet():
    rng = random.Random(2)
    for kinds in (2, 70, 30_000):
        text = "".join(chr(0x3400 + rng.randrange(kinds)) for _ in range(20_000)) + "12 \n 3\x00"
        grams, n = distinct([*streams(text), *streams("ab")])
        want = Counter(t[i - 4 : i + 1] for t in (plain(text), plain("ab")) for i in range(4, len(t)))
        assert {"".join(map(chr, g)): c for g, c in zip(grams.tolist(), n.tolist(), strict=True)} == want


def test_hashed_arrays():
    keys = ["", "a", "aa", "ab", "日本", "\nx"] + [f"k{i}" for i in range(3000)]
    table = Hashed(keys, np.arange(len(keys)))
    assert table.weights[table.find(table.hashes)].tolist() == table.weights.tolist()
    assert table.find(table.hashes + np.uint64(1)).tolist() == [-1] * len(keys)
    assert Hashed([], np.empty(0)).find(np.array([5], np.uint64)).tolist() == [-1]


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []
    got = quality_rules(spark.createDataFrame([(1, None, None, 1, None, None)], SCHEMA)).first()
    assert not got.kept and got.base_failed
