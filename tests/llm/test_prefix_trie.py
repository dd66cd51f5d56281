"""The prefix trie: against a trie of nested dictionaries, with hard cases and small bounds."""

import hashlib
import random
import zlib
from collections import defaultdict

from fotolake.llm import prefix_trie
from fotolake.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs long"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + t[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, d == len(seq)))
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ids = ",".join(str(c) for c, end in sorted(m) if end)
        out.append((min(m)[0], len(k), min(members[k[:-1]])[0] if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    return sorted(map(tuple, conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def corpus():
    rng = random.Random(3)
    texts = ["", "hi", None, "ü日" * 3, "a,b", "long " * 20_000]
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 999, -1, -100, -250, 2**62]:
        for t in range(rng.choice([1, 1, 2, 3, 7, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "user", None, "assistant"]), rng.choice(texts[:5] if rng.random() < 0.98 else texts), "clash", 7))
    rows += [(300, t, "user", f"turn {t}", None, None) for t in range(400)] + [(c, t, "user", f"turn {t}", None, None) for c in range(301, 340) for t in range(c - 298)]
    rows += rows[:15] + [(None, 1, "user", "no conversation", None, None)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_copies_ranges_of_ids_and_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = [(c, t, "user", "same", None, None) for c in range(1000, 1090) for t in range(8)] + [(1095, t, "user", "same", None, None) for t in range(12)]
    found = got(spark, rows)
    assert found == brute(rows)
    assert any(x[0] == 1000 and x[1] == 8 and x[3] == 91 for x in found)


def test_turnless_conversations_and_empty_table(spark):
    rows = [(1001, 0, "user", "x", None, None), (1007, 0, None, None, None, None)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] == got(spark, [(None, 0, "user", "x", None, None)])
