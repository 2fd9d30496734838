"""Functions of the library that no registered query calls, on fixed examples."""

import json

from pyspark.sql import functions as F

from quire.functions.geometry import Box, badge_number, relative
from quire.operators import fitting, greedy, repeat, rules, slots, spatial
from quire.sources import readers, sinks
from quire.streaming import jobs as streams

BOX = "page_id long, idx long, x1 int, y1 int, x2 int, y2 int"


def test_boxes_in_their_containers(spark):
    df = spark.createDataFrame([(10, 20, 30, 60, 0, 0, 100, 200, "7"), (0, 0, 10, 10, 5, 5, 5, 5, "12a")], "x1_a int, y1_a int, x2_a int, y2_a int, x1_b int, y1_b int, x2_b int, y2_b int, t string")
    got = df.select(relative(Box.of("_a"), Box.of("_b")).alias("r"), badge_number(F.col("t"), Box.of("_a")).alias("badge")).collect()
    assert tuple(got[0].r) == (0.1, 0.1, 0.3, 0.3) and tuple(got[1].r) == (-5.0, -5.0, 5.0, 5.0)
    assert [r.badge for r in got] == [False, False]
    badge = spark.createDataFrame([(0, 0, 30, 30, " 12 "), (0, 0, 30, 30, "1234"), (0, 0, 60, 30, "1")], "x1 int, y1 int, x2 int, y2 int, t string")
    assert [r[0] for r in badge.select(badge_number(F.col("t"), Box.of())).collect()] == [True, False, False]


def test_icon_rules(spark):
    rows = [(1, 0, 0, 0, 9, 9, "word", 0.9, None), (1, 1, 300, 300, 309, 309, "x", 0.9, None), (1, 2, 600, 0, 609, 9, "0101", 0.9, None), (1, 3, 600, 400, 609, 409, "ab", 0.5, None), (1, 4, 0, 500, 9, 509, "", 0.9, None), (1, 5, 300, 600, 309, 609, "x", 0.1, True), (1, 6, 12, 2, 15, 8, "y", 0.9, None), (1, 7, 700, 700, 709, 709, "★★", 0.9, None)]
    df = spark.createDataFrame(rows, BOX + ", text string, confidence double, force_text boolean")
    got = {r.idx: r.reason for r in rules.icon_rules(df).collect()}
    assert got == {0: "text", 1: "isolated_char", 2: "decor_binary", 3: "short_lowconf", 4: "preserve", 5: "forced", 6: "text", 7: "decor_symbol"}


def test_containers_and_paths(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 30, 30, "image"), (1, 1, 0, 0, 29, 30, "image"), (1, 2, 0, 0, 90, 90, "image"), (1, 3, 0, 0, 40, 40, "text")], BOX + ", kind string")
    assert [r.idx for r in spatial.container_candidates(df, F.lit(10_000)).collect()] == [0]
    wanted = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")], "slide int, rank int, path string")
    there = spark.createDataFrame([("c",), ("b",)], "path string")
    assert sorted(tuple(r) for r in spatial.path_fallback(wanted, there).collect()) == [(1, "b"), (2, None)]


def test_decisions_and_queue(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 9, 9, "isolated_char"), (1, 1, 5, 5, 9, 9, "text"), (1, 2, 6, 6, 9, 9, "short_lowconf")], BOX + ", reason string")
    decisions = spark.createDataFrame([(1, 0, 0, 9, 9, "keep", 0), (1, 0, 0, 9, 9, "drop", 1), (1, 5, 5, 9, 9, None, 0)], "page_id long, x1 int, y1 int, x2 int, y2 int, decision string, pos int")
    assert {r.idx: r.decision for r in repeat.override_join(boxes, decisions).collect()} == {0: "drop", 1: None, 2: None}
    assert [(r.idx, r.number, r.decision) for r in repeat.review_queue(boxes, ["text"]).orderBy("number").collect()] == [(0, 1, None), (2, 2, None)]


def test_slots(spark):
    texts = spark.createDataFrame([(1, i, x, 0, x + 9, 9, "s", size) for i, (x, size) in enumerate([(10, 10), (14, 12), (20, 11), (90, 10), (99, 30)])], BOX + ", style string, size int")
    classes = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 3), (1, 4, 3)], "page_id long, idx long, class_idx int")
    assert {r.idx: r.new_x1 for r in slots.column_snap(texts, classes).collect()} == {0: 14.0, 1: 14.0, 2: 14.0, 3: 90.0, 4: 99.0}
    assert {r.class_idx: r.reliable for r in slots.slot_guards(texts, classes).collect()} == {0: False, 3: False}
    assert {r.class_idx: r.reliable for r in slots.slot_guards(texts.withColumn("size", F.lit(10)), classes).collect()} == {0: False, 3: True}
    got = slots.slot_report(texts, classes.where("idx < 3")).collect()
    assert [tuple(r) for r in got] == [(1, 5, 1, 3, 2)]
    runs = spark.createDataFrame([(1, 0, [("(a)", 8, False), ("long text", 12, True), ("x", 9, False)]), (1, 1, [("(b)", 10, False), ("other text", 14, True)])], "page_id long, idx long, runs array<struct<text:string,size:int,bold:boolean>>")
    got = {r.role: (r["size"], r.bold, r.n) for r in slots.run_roles(runs, classes.where("class_idx = 0")).collect()}
    assert got == {"bracket": (9, False, 2), "main": (13, True, 2), "run_2": (9, False, 1)}


def test_tables(spark):
    tables = spark.createDataFrame([(1, 0, 0.9, 2, 2), (1, 1, float("nan"), 2, 2), (1, 2, 0.9, 2, 4), (1, 3, 0.9, 1, 2)], "page_id long, table_id int, score double, rows int, cols int")
    cells = spark.createDataFrame([(1, t, 1, 2) for t in range(4)], "page_id long, table_id int, rowspan int, colspan int")
    assert [r.table_id for r in greedy.table_accept(tables, cells).collect()] == [0]
    samples = spark.createDataFrame([(1, 0, 10, 5), (1, 0, 12, 5), (1, 3, 40, 5), (1, 4, 41, 5)], "k int, i int, v int, n int")
    assert greedy.grid_metrics(samples, ["k"]).first().bounds == [12.0, 12.0 + 28 / 3, 12.0 + 56 / 3, 40.0, 45.0]


def test_labels_and_tracking(spark):
    rows = spark.createDataFrame([("Name (x)",), ("Total: 12 items",), ("plain",), ("a: b",)], "t string")
    assert [tuple(r[0]) for r in rows.select(fitting.label_split(F.col("t"))).collect()] == [("Name ", "(x)"), ("Total:", " 12 items"), ("plain", None), ("a: b", None)]
    sizes = spark.createDataFrame([(90.0, 100.0, 5, 10.0), (104.0, 100.0, 5, 10.0), (120.0, 100.0, 5, 10.0), (101.0, 100.0, 1, 10.0)], "w double, room double, n int, size double")
    got = [round(r[0], 6) for r in sizes.select(fitting.char_spacing(F.col("w"), F.col("room"), F.col("n"), F.col("size"))).collect()]
    assert got == [0.0, -0.8, -0.8, -0.8]


def test_pages_layouts_and_texts(spark, tmp_path):
    files = spark.createDataFrame([("j", "b.png"), ("j", "a.png"), ("k", "z.png")], "job string, name string")
    assert sorted((r.job, r.name, r.page_name) for r in readers.renumber_pages(files).collect()) == [("j", "a.png", "page_01"), ("j", "b.png", "page_02"), ("k", "z.png", "page_01")]
    for name in ("combined.layout.json", "deck.layout.json", "page_01.layout.json"):
        (tmp_path / name).write_text("{}")
    assert [r.file for r in readers.scan_layouts(spark, str(tmp_path)).collect()] == ["page_01.layout.json"]
    (tmp_path / "page_01.layout.json").unlink()
    assert [r.file for r in readers.scan_layouts(spark, str(tmp_path)).collect()] == ["deck.layout.json"]
    items = spark.createDataFrame([("j", 2, 0, "c"), ("j", 1, 1, "b"), ("j", 1, 0, "a"), ("k", 1, 0, None)], "job string, page_id int, idx int, text string")
    assert [tuple(r) for r in readers.source_ref_text(items).collect()] == [("j", "a\nb\nc")]
    sinks.write_json(items.where("text is not null"), str(tmp_path / "out"))
    found = [json.loads(line) for p in sorted((tmp_path / "out").glob("page_id=*/*.json")) for line in p.read_text().splitlines()]
    assert sorted(x["text"] for x in found) == ["a", "b", "c"] and (tmp_path / "out" / "page_id=2").is_dir()


def test_running_views(spark, tmp_path):
    schema = "job_id long, owner_id long, seq long, status string, text string, page_id long, ts timestamp"
    rows = [(1, 7, 0, "queued", "a", 1), (2, 7, 1, "queued", "a", 2), (1, 7, 2, "done", " b ", 1), (3, 8, 3, "queued", "a", 1)]
    spark.createDataFrame(rows, schema.rsplit(", ", 1)[0]).withColumn("ts", F.timestamp_seconds(F.col("seq"))).coalesce(1).write.parquet(str(tmp_path / "in"))

    def result(view, name):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run = view(source).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        run.awaitTermination()
        return spark.table(name).collect()

    assert {r.owner_id: (r.active, r.admitted) for r in result(lambda s: streams.stream_quota(s, 2), "quota")} == {7: (1, True), 8: (1, True)}
    assert {r.job_id: r.status for r in result(lambda s: streams.stream_latest(s, key="job_id"), "latest")} == {1: "done", 2: "queued", 3: "queued"}
    assert {r.text: r.pages for r in result(streams.stream_template, "template")} == {"a": 2}
