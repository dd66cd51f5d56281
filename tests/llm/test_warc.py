"""WARC: exact round trips, revisits by brute force, damage found."""

import base64
import hashlib

import pytest

from fotolake.llm.warc import export, members, parse, read_archives, record, warc_round_trip, write_archives

ROWS = [(1, "<p>a"), (2, "<p>b"), (3, "<p>a"), (4, None), (5, ""), (6, "ü" * 70_000), (7, "x\r\n\r\ny"), (3, "<p>a"), (None, "<p>b"), (None, "only null")]


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "page_id long, html string").selectExpr("*", "'u' as url", "1 as payload", "2 as refers_to", "3 as record_type")
    want = []
    for page, html in ROWS:
        data = (html or "").encode()
        last = max((p for p, h in ROWS if (h or "").encode() == data and p is not None), default=None)
        revisit = last is not None and page != last
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    assert sorted(map(repr, (tuple(r) for r in warc_round_trip(df).collect()))) == sorted(map(repr, want))
    assert warc_round_trip(df.limit(0)).collect() == []


def test_payloads_and_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:8], "page_id long, html string").withColumnRenamed("x", "y").selectExpr("*", "concat('http://x/', page_id) as url")
    archives = write_archives(df, segment=1000)
    got = {r.page_id: r for r in read_archives(archives).collect()}
    assert got["6"].payload.decode() == "ü" * 70_000 and got["7"].payload == b"x\r\n\r\ny" and got["2"].url == "http://x/2" and got["1"].payload == b""
    names = [r.name for r in export(archives, f"file://{tmp_path}").collect()]
    assert sum(1 for n in names for _ in members((tmp_path / n).read_bytes())) == 8


def test_damage_is_found():
    good = record(1, "http://x", b"payload" * 100, None, "response") + record(2, "http://y", b"", 1, "revisit")
    assert [parse(m)["page_id"] for m in members(good)] == ["1", "2"]
    for bad in (good[:-3], good[:40] + b"\x00" + good[41:]):
        with pytest.raises(ValueError):
            [parse(m) for m in members(bad)]
    text = next(members(good))
    for bad in (text.replace(b"payloadpayload", b"payloadpayl0ad", 1), text[:-5], text.replace(b"WARC/", b"WARX/")):
        with pytest.raises(ValueError):
            parse(bad)


def test_text_ids_and_digests_beyond_the_bound(spark, monkeypatch):
    from fotolake.llm import warc

    rows = [("None", "<p>a"), (None, "<p>b"), ("x> \r\n%41é", "<p>a"), ("z", "<p>c"), ("", "<p>c")]
    df = spark.createDataFrame(rows, "page_id string, html string").selectExpr("*", "'u' as url")
    want = sorted(map(repr, [("None", "revisit", "x> \r\n%41é"), (None, "response", None), ("x> \r\n%41é", "response", None), ("z", "response", None), ("", "revisit", "z")]))
    for bound in (warc.BROADCAST_DIGESTS, 0):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", bound)
        assert sorted(repr((r.page_id, r.record_type, r.refers_to)) for r in warc_round_trip(df).collect()) == want
