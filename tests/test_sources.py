"""Readers, sinks and streams over small files that the tests write."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import values as V
from quire.sources import readers, sinks
from quire.streaming import jobs as streams


def test_scan_items(spark, tmp_path):
    items = [{"text": "a", "x1": 1, "y1": 2, "x2": 3, "y2": 4, "confidence": 0.5}, {"text": "b", "x1": 0, "y1": 0, "x2": 1, "y2": 1, "_force_text": True}]
    (tmp_path / "page_07.ocr.json").write_text(json.dumps(items, indent=1))
    (tmp_path / "page_07.ocr.raw.json").write_text("[]")
    (tmp_path / "page_08.ocr.json").write_text("{}")
    got = readers.scan_items(spark, str(tmp_path)).orderBy("page_id", "idx").collect()
    assert [(r.page_id, r.idx, r.text, r.x2, r.force_text) for r in got] == [("07", 0, "a", 3, None), ("07", 1, "b", 1, True)]


def test_scan_tolerant(spark):
    good = {"text": " hi ", "x1": 0, "y1": 0, "x2": 5, "y2": 5}
    rows = [(1, json.dumps([good, 3, {"text": " "}])), (2, json.dumps({"results": [good | {"x2": -1}, good]})), (3, "not json"), (4, None), (5, json.dumps({"items": []}))]
    got = readers.scan_tolerant(spark.createDataFrame(rows, "page_id long, value string")).orderBy("page_id").collect()
    assert [(r.page_id, r.idx, r.text, r.confidence) for r in got] == [(1, 0, "hi", 1.0), (2, 1, "hi", 1.0)]


def test_flatten_predictions(spark):
    rows = [(1, ["ab c", "x", " "], [0.9, 0.1], [[[0, 0], [9, 1], [9, 5], [0, 5]], [[0, 0]], [[0, 0]]], [["ab", "c"], ["y"], None])]
    df = spark.createDataFrame(rows, "page_id long, texts array<string>, scores array<double>, polys array<array<array<int>>>, words array<array<string>>")
    got = readers.flatten_predictions(df).collect()
    assert [(r.idx, r.text, r.x1, r.y1, r.x2, r.y2, r.words) for r in got] == [(0, "ab c", 0, 0, 9, 5, ["ab", "c"])]


def test_glyphs_to_lines(spark):
    line = [(1, 1, i, ch, i * 10, 0, i * 10 + 8, 9) for i, ch in enumerate(" ab  c ")]
    got = readers.glyphs_to_lines(spark.createDataFrame(line, "page_id long, line_id long, i int, ch string, x1 int, y1 int, x2 int, y2 int")).collect()
    assert [(r.text, r.x1, r.x2, r.idx) for r in got] == [("ab  c", 10, 58, 0)]


def test_pages(spark):
    names = spark.createDataFrame([("page_2.png",), ("page_10.PNG",), ("page_123.jpg",), ("cover.png",)], "name string")
    pages = readers.discover_pages(names)
    assert [(r.page, r.page_id) for r in pages.collect()] == [(2, "02"), (10, "10"), (123, "123")]
    assert [r.page for r in readers.page_select(pages, "10,2").collect()] == [10, 2]
    with pytest.raises(Exception, match="no page 5"):
        readers.page_select(pages, "5").collect()
    with pytest.raises(Exception, match="is there twice"):
        readers.discover_pages(spark.createDataFrame([("page_1.png",), ("page_01.png",)], "name string")).collect()


def test_uploads(spark):
    files = spark.createDataFrame([(1, "a.pdf"), (2, "a.png"), (3, "a.png"), (3, "b.JPG"), (4, "a.pdf"), (4, "b.png"), (5, "x.txt")], "job long, name string")
    assert {r.job: r.kind for r in readers.classify_upload(files).collect()} == {1: "pdf", 2: "image", 3: "dir", 4: "reject", 5: "reject"}
    raw = [("a.png", b"\x89PNG...."), ("a.jpg", b"\x89PNG"), ("a.webp", b"RIFF0000WEBPxx"), ("b.webp", b"RIFF0000WAVExx"), ("a.txt", b"text"), ("c.png", None)]
    assert {r.path: r.magic_ok for r in readers.magic_check(spark.createDataFrame(raw, "path string, content binary")).collect()} == {"a.png": True, "a.jpg": False, "a.webp": True, "b.webp": False, "a.txt": False, "c.png": False}
    zips = [("ok", "a/b.txt", 10, 0o100644), ("up", "../x", 1, None), ("link", "l", 1, 0o120777), ("abs", "/etc", 1, None)]
    assert {r.archive: r.ok for r in readers.archive_guard(spark.createDataFrame(zips, "archive string, name string, size long, mode int")).collect()} == {"ok": True, "up": False, "link": False, "abs": False}
    caps = spark.createDataFrame([(1, 0, 50), (1, 1, 60), (2, 0, 500), (3, 0, 1), (3, 1, 1), (3, 2, 1)], "job long, pos int, size long")
    got = {r.job: r.violation for r in readers.upload_caps(caps, each=100, total=100, count=2).collect()}
    assert got == {1: "total_size", 2: "file_size", 3: "file_count"}


def test_walk_text(spark):
    doc = {"text": "a", "x": [{"text": "b"}, {"text": {"text": "c"}}, {"other": "d"}], "text2": "e"}
    got = readers.walk_text(spark.createDataFrame([(1, json.dumps(doc)), (2, "bad")], "k long, value string"), ["k"])
    assert sorted(r.text for r in got.collect()) == ["a", "b", "c"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f1", 1.0), ("f2", 2.0)], "fixture string, composite double")
    path = str(tmp_path / "base")
    sinks.upsert(spark, df, path)
    sinks.upsert(spark, spark.createDataFrame([("f2", 3.0)], "fixture string, composite double"), path)
    assert sorted(map(tuple, sinks.read_baseline(spark, path).collect())) == [("f1", 1.0), ("f2", 3.0)]
    raw = str(tmp_path / "raw")
    sinks.raw_backup(df, raw)
    sinks.raw_backup(df.limit(1), raw)
    assert spark.read.parquet(raw).count() == 2
    one = sinks.source_markers(spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary"))
    two = sinks.source_markers(spark.createDataFrame([("a", b"1"), ("b", b"3"), ("c", b"4")], "path string, content binary"))
    assert sorted(r.name for r in sinks.changed_sources(two, one).collect()) == ["b", "c"]


def test_scalars(spark):
    row = spark.range(1).select(
        T.weighted_length(F.lit("ab你")).alias("w"),
        T.safe_name(F.lit("../x/.hid den.png")).alias("n"),
        T.slug(F.lit("a b/c!.")).alias("s"),
        T.list_prefix(F.lit("3. item")).alias("l"),
        T.list_prefix(F.lit("3.5 kg")).alias("m"),
        T.stat_value(F.lit("12.5%")).alias("v"),
        T.normalise(F.lit("Ａ b，"), compatibility=True).alias("k"),
        V.ladder_snap(F.lit(15)).alias("lad"),
        V.rgb(F.lit("#0aF00B")).alias("c"),
        V.format_eta(F.lit(4000)).alias("e"),
        T.split_prefix(F.lit("a|word"), F.lit(0), F.lit(300), F.lit(10)).alias("sp"),
    ).first()
    assert (row.w, row.n, row.s, row.l.kind, row.l.start, row.l.rest, row.m.kind, row.v) == (4, "hid den.png", "a_b_c", "number", 3, "item", None, True)
    assert (row.k, row.lad, tuple(row.c), row.e, row.sp.text, row.sp.x1) == ("ab,", 14, (10, 240, 11), "1 h 7 min", "word", 29)


def run(stream, mode, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "=== 1/4 x"), (1, 2, "page 3: ok"), (1, 3, "page 2: ok"), (2, 1, "note")], "job_id long, seq long, line string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    log.write.parquet(str(tmp_path / "log"))
    source = lambda: spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    run(streams.stream_progress(source()), "update", "progress", tmp_path)
    assert sorted(map(tuple, spark.table("progress").collect())) == [(1, 25, 3, 3), (2, 0, 0, 1)]
    run(streams.stream_tail(source(), 2), "update", "tail", tmp_path)
    assert {r.job_id: r.tail for r in spark.table("tail").collect()} == {1: "page 3: ok\npage 2: ok", 2: "note"}
    rows = [(1, i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 10, 20, 59])] + [(1, 9, "2024-01-01 00:01:00")]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "ev"))
    run(streams.stream_ratelimit(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), 2), "append", "limits", tmp_path)
    assert {r.event_id: r.accepted for r in spark.table("limits").collect()} == {0: True, 1: True, 2: False, 3: False, 9: True}


def test_fanout(spark):
    messages = spark.createDataFrame([(1, "m")], "job_id long, body string")
    jobs = spark.createDataFrame([(1, 5)], "id long, owner_id long")
    users = spark.createDataFrame([(5, True), (6, True), (7, False)], "user_id long, is_admin boolean")
    assert sorted(r.user_id for r in streams.stream_fanout(messages, jobs, users).collect()) == [5, 6]
