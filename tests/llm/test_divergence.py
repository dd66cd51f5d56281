"""Source divergence: against the sums over all terms, one by one, with hard cases and small bounds."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fotolake.llm import divergence
from fotolake.llm.divergence import source_divergence, terms

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value double"


def brute(rows, least_docs=10, ranks=10):
    by_lang, groups, seen = defaultdict(lambda: defaultdict(int)), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low))
        groups[lang or "", source or ""].update(words)
        seen.add((lang or "", source or ""))
        for w in words:
            by_lang[lang or ""][w] += 1
    out = []
    for lang in {x for x, _ in seen}:
        kept = {w for w, n in by_lang[lang].items() if n >= least_docs}
        own = {s: {w: groups[lang, s][w] for w in kept} for x, s in seen if x == lang}
        total = {w: sum(c[w] for c in own.values()) for w in kept}
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        q, shares = p(total), {s: p(c) for s, c in own.items()}
        for s, mine in shares.items():
            pairs = [(-sum(f(mine[w], shares[o][w]) for w in kept), o) for o in shares if o != s]
            best = [(-f(mine[w], q[w]), w) for w in kept if own[s][w] > 0 and mine[w] > q[w]]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < ranks]
    return sorted(out)


def corpus():
    rng = random.Random(7)
    words = ["the", "The", "of", "ÜBER", "über", "ß", "日本", "a" * 90, "x1y", "don't", *(f"w{c}" for c in "abcdefghijklmnopqrst")]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "Ünder", "z'\n"]), "clash", 1, 2.0) for i in range(220)]
    rows += [(1, "the the w w wa", "en", "s1", None, 1, None)] * 30 + [(None, None, "en", "only null", None, None, None), (None, "", "xx", "bare", None, None, None), (5, "12 !", "xx", "s1", None, None, None)]
    rows += [(9, " ".join(f"{w} {w}" for w in words) * 900, "en", "long", None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def got(spark, rows, **kw):
    return sorted(map(tuple, source_divergence(spark.createDataFrame(rows, SCHEMA), **kw).collect()))


def test_against_brute_force(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_small_bounds_give_the_same(spark, rows, monkeypatch):
    for name, value in (("PIECE", 64), ("BROADCAST_TERMS", 0), ("HELD", 7), ("BLOCK", 9), ("PAIRS", 5), ("FIRST_REACH", 1), ("FURTHER", 2)):
        monkeypatch.setattr(divergence, name, value)
    assert got(spark, rows, least_docs=3, ranks=2) == brute(rows, 3, 2)


def test_ties_at_the_last_rank_are_ordered_by_item(spark):
    rows = [(i, " ".join(f"t{c}" for c in "qwertyuiopasdfghjkl"), "en", "same", None, None, None) for i in range(10)] + [(i, "u v", "en", "other", None, None, None) for i in range(10)]
    found = got(spark, rows)
    assert found == brute(rows)
    assert [x[3] for x in found if x[1] == "same" and x[2] == "term"] == sorted(f"t{c}" for c in "qwertyuiopasdfghjkl")[:10]


def test_empty_table_and_no_terms(spark):
    assert got(spark, []) == []
    rows = [(1, "a", "en", "x", None, None, None), (2, None, "en", "y", None, None, None)]
    assert got(spark, rows) == brute(rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_terms_are_runs_of_letters():
    assert [*terms("Ab-c_d É9é\x00" + "x" * 3)] == [[b"ab", b"c", b"d", "É".encode(), "é".encode(), b"xxx"]]
    assert sum(terms(None), []) == [] == sum(terms(" 12 "), [])


def test_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000
    row = spark.createDataFrame([(big, 2 * big, 1000)], "c long, n long, v long").select(divergence.share(*map(F.col, "cnv")).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (2 * big + 2000)
