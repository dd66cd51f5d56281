"""The pipeline's stages on planted documents and on the small tables."""

import os
import random

import corpus_pipeline as c
from fotolake.llm import common, decontaminate, simhash
from fotolake.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    text = docs.where("n_chars between 1400 and 2000").orderBy("doc_id").first().text
    extra = [(9001, text + " " + item, "en", "p", 1), (9002, text + ' extra token = "0123456789abcdef0123456789abcdef" words.', "en", "p", 1), (9003, text[::-1], "en", "p", 1), (9003, text[::-1], "en", "p", 1), (None, None, None, None, None)]
    planted = spark.createDataFrame(extra, docs.schema)
    docs = docs.unionByName(planted)
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near_duplicates":
            assert docs.count() == len(ids) and 9002 not in ids
        if name == "decontamination":
            assert 9001 not in ids
    assert docs.where("text rlike 'token = \"[0-9a-f]{32}'").count() == 0
    assert {f.name for f in c.STAGES[-1][1](spark, docs, SF).schema} >= {"doc_id", "start", "sequence_id", "offset"}


def test_run(spark):
    assert c.run(spark, SF).count() > 0


def test_near_copies_by_brute_force(spark):
    """Null ids, ids shared by different texts, repeated rows, clashing and odd columns, no column lost."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, d = fresh(60), fresh(60), fresh(4)
    near = a[:50] + fresh(1) + a[51:]
    texts = [(1, a), (5, a), (5, b), (None, a), (None, near), (None, d), (None, d), (7, near), (8, None), (None, None), (9, []), (3, d), (3, d), (6, fresh(80))]
    rows = [(i, None if t is None else " ".join(t), n, {"k": n}) for n, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `key.id` int, last map<string,int>").selectExpr("*", "1 as node", "'x' as fingerprint", "2 as f0")
    got = c.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id, r.text or "") for r in got.collect())
    assert kept == sorted([(1, " ".join(a)), (5, " ".join(b)), (3, " ".join(d)), (8, ""), (6, " ".join(texts[-1][1]))])
    assert c.drop_near_duplicates(spark, docs.limit(0), SF).collect() == []


def test_joins_beyond_their_bounds(spark, monkeypatch):
    """The same rows by shuffle as by broadcast."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda: sorted(r.doc_id for r in c.decontaminate(spark, written(c.drop_near_duplicates(spark, docs, SF), "near"), SF).collect())
    want = rows()
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(simhash, "BROADCAST_CANDIDATES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert rows() == want and 0 < len(want) < docs.count()


def test_empty_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []


def test_tables_are_cleared(spark):
    table = written(spark.range(3), "some")
    assert table.count() == 3 and "/tables-" in table.inputFiles()[0]
    common.clear(spark)
    assert not os.path.exists(table.inputFiles()[0].removeprefix("file://"))
