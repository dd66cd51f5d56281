"""Streams run to their end over files, and agree with the batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from fotolake.operators.catalog import coalesced
from fotolake.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def test_import_stream(spark, tmp_path):
    done = str(tmp_path / "done")
    spark.createDataFrame([("/a/old.CR3", None)], "path string, master long").write.parquet(done)
    for i, names in enumerate((["old.CR3", "x.jpg", ".hidden.jpg"], ["x.jpg", "y.txt", "z.NEF"])):
        spark.createDataFrame([(f"/a/{n}", 1) for n in names], "path string, size long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    files = spark.readStream.schema("path string, size long, b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select("path", "size")
    known = lambda: spark.read.parquet(done)
    streams.import_stream(files, known, lambda df, n: df.select("path", F.lit(None).cast("long").alias("master")).write.mode("append").parquet(done), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.path for r in known().collect()) == ["/a/old.CR3", "/a/x.jpg", "/a/z.NEF"]


def test_latest_wins(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "slot string, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema("slot string, seq long").parquet(str(tmp_path / "in"))
    streams.latest_wins(stream, "slot", "seq", lambda df, n: out.extend(tuple(r) for r in df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(out) == [("a", 3), ("b", 2)]
    again = []
    known = lambda: spark.createDataFrame([("a", 3), ("b", 1)], "slot string, seq long")
    streams.latest_wins(stream, "slot", "seq", lambda df, n: again.extend(tuple(r) for r in df.collect()), str(tmp_path / "d"), known).awaitTermination(120)
    assert again == [("b", 2)]


def test_coalesced_edits_and_sessions(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ms = lambda n: T0 + dt.timedelta(milliseconds=n)
    rows = [(1, 1, "a", ms(0)), (1, 2, "a", ms(300)), (1, 3, "b", ms(500)), (1, 4, "b", ms(1400)), (2, 5, "a", ms(100))]
    df = spark.createDataFrame(rows, "photo long, id long, label string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "p=1"))
    spark.createDataFrame([(9, 99, "end", ms(3_600_000))], df.schema).coalesce(1).write.parquet(str(tmp_path / "in" / "p=2"))
    stream = spark.readStream.schema("photo long, id long, label string, ts timestamp, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("p")
    q = streams.coalesce_edits(stream, "photo", 600).writeStream.format("memory").queryName("edits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.key, r.id) for r in spark.table("edits").where("key <> 9").collect())
    assert got == sorted((r.photo, r.id) for r in coalesced(df, "photo").collect()) == [(1, 2), (1, 3), (1, 4), (2, 5)]
    s = streams.gap_sessions(stream, "photo", "ts", "1 second").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    s.awaitTermination(180)
    assert sorted((r.photo, r.n) for r in spark.table("sessions").where("photo <> 9").collect()) == [(1, 4), (2, 1)]
