"""Export jobs: single failures, tasks that ran twice, a second pass that runs again."""

import os

from pyspark.sql import functions as F

from fotolake.operators import export as x

ITEMS = [(1, "a/1.txt", "one"), (2, "a/2.txt", "two"), (3, None, "three"), (4, "b/4.txt", None), (5, "../5.txt", "five"), (6, "b/6.txt", ""), (7, "c/7.txt", "bad"), (8, "same", "x"), (9, "same", "y")]


def render(row):
    if row["content"] == "bad":
        raise RuntimeError("cannot render")
    return None if row["content"] is None else row["content"].upper().encode()


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f)).read() for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")}


def test_failures_are_rows(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    items = spark.createDataFrame(ITEMS, "id long, dest string, content string").repartition(3)
    got = {r.id: r for r in x.export(items, target, f"{tmp_path}/status", render).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "ok", 2: "ok", 3: "skipped", 4: "failed", 5: "failed", 6: "ok", 7: "failed", 8: "failed", 9: "failed"}
    assert got[7].error == "RuntimeError: cannot render" and "outside" in got[5].error and got[4].error == "ValueError: no content" and "not moved" in got[8].error
    assert files(tmp_path / "out") == {"a/1.txt": "ONE", "a/2.txt": "TWO", "b/6.txt": ""}
    assert {r.status: (r.items, r.bytes) for r in x.counts(spark.createDataFrame(list(got.values()), "id long, dest string, status string, error string, bytes long, sha256 string")).collect()} == {"ok": (3, 6), "failed": (5, 0), "skipped": (1, 0)}


def test_tasks_and_moves_that_run_again(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    items = spark.createDataFrame(ITEMS[:3], "id long, dest string, content string")
    x.attempted(items, target, "job").collect()  # an attempt that was lost: its files stay without rows
    first = x.attempted(items, target, "job")
    first.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert x.committed(rows.where("id = 1"), target).collect()[0].moved  # a pass that ended early
    for _ in range(2):
        assert {r.id: r.moved for r in x.committed(rows, target).collect()} == {1: True, 2: True}
    assert {k: v for k, v in files(tmp_path / "out").items() if not k.startswith(".attempts")} == {"a/1.txt": "one", "a/2.txt": "two"}
    os.remove(tmp_path / "out" / "a" / "1.txt")
    assert {r.id: r.moved for r in x.committed(rows, target).collect()} == {1: False, 2: True}


def test_done_items_are_skipped(spark, tmp_path):
    items = spark.createDataFrame(ITEMS[:2], "id long, dest string, content string")
    first = x.export(items.where("id = 1"), f"file://{tmp_path}/out", f"{tmp_path}/s1")
    again = x.export(items.withColumn("content", F.upper("content")), f"file://{tmp_path}/out", f"{tmp_path}/s2", done=first)
    assert {r.id: r.status for r in again.collect()} == {1: "skipped", 2: "ok"}
    assert files(tmp_path / "out") == {"a/1.txt": "one", "a/2.txt": "TWO"}
    empty = x.export(items.limit(0), f"file://{tmp_path}/none", f"{tmp_path}/s3")
    assert empty.collect() == []
