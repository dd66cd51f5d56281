"""Packing: ids against the tokenizers library, gapless windows, capacity, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fotolake.llm import packing
from fotolake.llm.packing import Encoder, differencing, encoder, pack, windows

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a\n b", "a \nb\n", "it's 's x'S", "a \x1c b", "<|endoftext|> x <|endoftext|>", "é ñ½² ٣٤ x y z ", "\n\n a", "a \n", "日本 語 x😀 y😀😀", "a\tb \tc d\n\n", "x ' s", "foo\n \nbar", "\n x", "a 　 b  c"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids(plain):
    encode = Encoder(PATH)
    rng = random.Random(1)
    for text in ODD + ["".join(rng.choices(" \n\tab'1.é", k=30)) for _ in range(2000)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain(text), repr(text)


def test_added_tokens(plain):
    """An added token anywhere in a text has its own id, as the library's plain call has it."""
    encode, mark = Encoder(PATH), "<|endoftext|>"
    assert plain("a <|endoftext|> b")[2] == plain(mark)[0] and len(plain(mark)) == 1
    words = ["one", "two ", " three", "four\n"]
    for at in range(len(words) + 1):
        for glue in ("", " ", "  ", "\n"):
            text = glue.join([*words[:at], mark, *words[at:]])
            assert np.frombuffer(encode(text), "<u4").tolist() == plain(text), repr(text)
            half = text.replace("|>", "| >")
            assert np.frombuffer(encode(half), "<u4").tolist() == plain(half), repr(half)


def test_texts_encoded_together(plain, monkeypatch):
    """Parts of all texts of a batch meet in the library's calls; the ids are those of each text alone, also when kept parts are dropped."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéßж中'", k=rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "?!", "'", "...---...--", ".\nX", "1", "_", "²", "\u1c89"]) for _ in range(3000)]
    words += ["w" * 200, "'s", "it's", "don'ts,", "3.14", "a\tb", "x\u00a0", "\u00a0", "<|endoftext|>", ".", "😀", "𝒳𝒴", "\U0001f600.", "\x00", "\x1c", "Ġa", "Ċ"]
    texts = [*ODD, *(" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 40]))) + rng.choice(["", "", " ", "\n", "  "]) for _ in range(600))]
    texts = [t.replace("  ", " ") if i % 2 else t for i, t in enumerate(texts)]
    want = [plain(t) for t in texts]
    for cache, joined in ((400_000, 1000), (50, 7)):
        monkeypatch.setattr(packing, "CACHE", cache)
        monkeypatch.setattr(packing, "JOINED", joined)
        for kind in (pa.string(), pa.large_string()):
            encode = Encoder(PATH)
            for _ in range(2):
                got = [np.frombuffer(x, "<u4").tolist() for x in encode.many(pa.array(texts, kind))]
                assert got == want
            assert len(encode.new) <= cache and len(encode.old) <= cache and max(map(len, encode.new)) <= packing.LONGEST
    assert list(encode.many(pa.array([], pa.string()))) == []


def test_library_is_called_for_many_parts_and_once(monkeypatch):
    """Ten thousand distinct parts take some calls of a thousand parts, not one each; parts known from an earlier task take none."""
    asked = []
    monkeypatch.setattr(Encoder, "whole", lambda self, text, by=None, f=Encoder.whole: asked.append(text) or f(self, text, by))
    letters = "abcdefghij"
    words = ["w" + "".join(letters[int(d)] for d in f"{i:04d}") + ("." if i % 3 == 0 else "7" if i % 3 == 1 else "") for i in range(10_000)]
    texts = pa.array([" ".join(["", *words[i : i + 500]]) for i in range(0, 10_000, 500)])
    encode = Encoder(PATH)
    first = list(encode.many(texts))
    assert len(asked) - len(texts) <= 20
    asked.clear()
    assert list(encode.many(texts)) == first
    assert len(asked) == len(texts)  # the first part of each
    assert encoder(PATH) is encoder(PATH)


def test_files_of_other_kinds(tmp_path):
    """A file that is not byte-level, or cuts texts short, is used as it is; one without letters for all bytes too."""
    from tokenizers import models, pre_tokenizers

    texts = ["a b", "b  a c", "", "a", "c c c a"]
    plain = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.Whitespace()
    short = Tokenizer.from_file(PATH)
    short.enable_truncation(2)
    poor = Tokenizer(models.BPE({"a": 0, "Ġ": 1, "Ġa": 2}, [("Ġ", "a")]))
    poor.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for i, kind in enumerate((plain, short, poor)):
        kind.save(path := str(tmp_path / f"{i}.json"))
        want = [kind.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).many(pa.array(texts))] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows_hold(sizes):
    fill = np.bincount(windows(sizes, 100), weights=sizes)
    assert fill.max() <= 100
    assert set(differencing(sizes, 3)) <= {0, 1, 2}


def test_differencing_of_known_sets():
    sums = lambda s, k: sorted(np.bincount(differencing(s, k), weights=s, minlength=k).tolist())
    assert sums([4, 5, 6, 7, 8], 2) == [14, 16]  # the textbook case: differencing ends at 2
    assert sums([5, 5, 5, 5, 5, 5], 3) == [10, 10, 10]


def test_whole_corpus(spark, plain):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "Gamma,", "delta\n"], k=rng.choice([1, 20, 300, 3000])))) for i in range(60)] + [(100, None), (101, ""), (None, "x"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("*", "1 as length", "2 as offset")
    got = pack(docs, PATH, capacity=512, keep_ids=True).collect()
    by, windows_of = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by[r.doc_id, r.doc_tokens].append((r.start, r.ids))
        windows_of[r.sequence_id].append((r.offset, r.length))
    for doc, text in rows:
        want = [*plain(text or ""), 1]
        assert [x for _, ids in sorted(by[doc, len(want)]) for x in ids] == want
    for pieces in windows_of.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(r.length for r in got) >= 0.93 * 512 * len(windows_of)
    assert pack(docs.limit(0), PATH).collect() == []
