"""Slots of slides on odd rows, and streams that are run again."""

import datetime as dt

from quire.operators import bullets, jobs, slot_edges
from quire.streaming import jobs as streams

TEXTS = "page_id long, idx int, x1 double, y1 double, x2 double, y2 double, text string, align string, font string, size double, bold boolean, marked boolean, rgb struct<r: int, g: int, b: int>"
CARDS = "page_id long, idx int, x1 double, y1 double, x2 double, y2 double"
BLUE, RED = (20, 60, 200), (220, 30, 30)


def text(idx, x, y, w=60.0, h=16.0, content="some words", size=14.0, bold=True, rgb=BLUE, font="", align="left"):
    return (1, idx, x, y, x + w, y + h, content, align, font, size, bold, False, rgb)


def reasons(spark, texts, cards):
    found = slot_edges.pair_edges(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(cards, CARDS))
    return {(r.a, r.b): set(r.reasons) for r in found.collect()}


def test_each_reason_of_a_pair(spark):
    cards = [(1, 100, 0.0, 0.0, 300.0, 200.0), (1, 101, 310.0, 0.0, 610.0, 200.0)]
    same = [text(1, 20.0, 20.0), text(2, 330.0, 20.0)]
    assert reasons(spark, same, cards) == {(1, 2): {"row", "relative_slot"}}
    # alert bands may differ in width, but stand low, are red, bold and not short
    alert = [text(1, 20.0, 150.0, w=40.0, content="warning text", rgb=RED), text(2, 330.0, 160.0, w=200.0, content="warning text", rgb=RED)]
    assert reasons(spark, alert, cards) == {(1, 2): {"alert_band"}}
    assert reasons(spark, [t[:6] + ("short", *t[7:]) for t in alert], cards) == {}
    listed = [text(1, 20.0, 20.0), text(2, 30.0, 110.0)]
    assert reasons(spark, listed, cards) == {(1, 2): {"vertical_list"}}
    titles = [text(1, 20.0, 20.0, content="Alpha", size=24.0), text(2, 200.0, 150.0, content="Beta", size=30.0)]
    assert reasons(spark, titles, cards) == {(1, 2): {"latin_title"}}
    assert reasons(spark, [text(1, 20.0, 20.0), text(2, 24.0, 60.0, rgb=None)], cards) == {}
    assert reasons(spark, [], cards) == {} and reasons(spark, same, []) == {}


def test_columns_link_as_all_pairs_do(spark):
    xs = [0.0, 20.0, 45.0, 46.0, 90.0, 100.0, 23.0, 300.0]
    fonts = ["A", "", "B", "A", "", "B", "B", "A"]
    sizes = [14.0, 15.0, 16.0, 16.5, 14.0, 15.0, 13.0, 14.0]
    rows = [text(i, x, 20.0 * i, font=f, size=s, rgb=(20, 20, 20) if i % 2 else (100, 100, 100)) for i, (x, f, s) in enumerate(zip(xs, fonts, sizes, strict=True))]
    placed = slot_edges.placed_texts(spark.createDataFrame(rows, TEXTS), slot_edges.containment_join(spark.createDataFrame(rows, TEXTS), spark.createDataFrame([(1, 99, -10.0, -10.0, 500.0, 500.0)], CARDS)))
    group = {i: {i} for i in range(len(xs))}

    def join(i, j):
        both = group[i] | group[j]
        for k in both:
            group[k] = both

    for i in range(len(xs)):
        for j in range(i):
            if abs(xs[i] - xs[j]) <= 24 and abs(sizes[i] - sizes[j]) <= 2 and (not fonts[i] or not fonts[j] or fonts[i] == fonts[j]):
                join(i, j)
    want = {frozenset(g) for g in group.values()}
    group = {i: {i} for i in range(len(xs))}
    for r in slot_edges.column_edges(placed).collect():
        join(r.a, r.b)
    assert {frozenset(g) for g in group.values()} == want


def test_missing_markers_are_inferred(spark):
    box = lambda i, x: (1, i, x, 30.0 * i, x + 100, 30.0 * i + 20, False)
    texts = spark.createDataFrame([box(0, 50.0), box(1, 52.0), box(2, 56.0), box(3, 300.0), (2, 0, 0.0, 0.0, 1.0, 1.0, None)], f"{CARDS}, ignored boolean")
    classes = spark.createDataFrame([(1, i, 0) for i in range(4)] + [(2, 0, 0)], "page_id long, idx int, class_idx int")
    marks = spark.createDataFrame([(1, 0, "wide.png", 30.0, 5.0, 60.0, 15.0), (1, 1, "dot.png", 34.0, 35.0, 44.0, 45.0), (1, 2, None, 0.0, 0.0, 9.0, 9.0)], "page_id long, idx int, path string, x1 double, y1 double, x2 double, y2 double")
    got = {r.idx: r for r in bullets.bullet_priors(texts, classes, marks).collect()}
    assert set(got) == {0, 1, 2} and [got[i].inferred for i in range(3)] == [False, False, True]
    assert {(r.path, r.marker_x, r.marker_w, r.marker_h, r.new_x1) for r in got.values()} == {("dot.png", 32.0, 10.0, 10.0, 51.0)}
    assert got[2].marker_y == 65.0
    assert bullets.bullet_priors(texts, classes, marks.where("false")).count() == 0


def test_sliding_limit_keeps_both_kinds_of_time(spark):
    for kind in ("timestamp", "timestamp_ntz"):
        rows = spark.sql(f"select 1L as user_id, id as event_id, cast('2024-01-01 00:00:00' as {kind}) + make_dt_interval(0, 0, 0, id * 20) as ts from range(8)")
        got = jobs.sliding_limit(rows, 2)
        assert got.schema["ts"].dataType == rows.schema["ts"].dataType
        assert [r.accepted for r in got.orderBy("event_id").collect()] == [True, True, False] * 2 + [True, True]


def test_active_jobs_count_once(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m)
    schema = "owner_id long, job_id long, seq long, status string, ts timestamp"

    def feed(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        seen = {}
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = streams.stream_quota(source, 2).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q.foreachBatch(lambda df, _: seen.update({r.owner_id: (r.active, r.admitted) for r in df.collect()})).start().awaitTermination()
        return seen

    assert feed("a", [(1, 10, 1, "queued", at(0)), (1, 10, 1, "queued", at(0)), (1, 11, 1, "queued", at(1))]) == {1: (2, False)}
    # a restart goes on from the state; what comes again or late changes nothing
    assert feed("b", [(1, 10, 3, "done", at(3)), (1, 10, 2, "running", at(2)), (1, 11, 1, "queued", at(1))]) == {1: (1, True)}
    assert feed("c", [(2, 20, 1, "queued", at(900)), (1, 11, 2, "running", at(900))]) == {1: (1, True), 2: (1, True)}
    # older than the watermark: dropped
    assert feed("d", [(1, 10, 1, "queued", at(0)), (2, 20, 2, "failed", at(901))]) == {2: (0, True)}


def test_latest_and_progress_forget_idle_keys(spark, tmp_path):
    at = lambda m, us=0: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m, microseconds=us)

    def feed(view, schema, name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / view.__name__ / name))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / view.__name__))
        out, held = [], []
        q = view(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / f"{view.__name__}-cp")).trigger(availableNow=True)
        q = q.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).start()
        q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return sorted(out), held[-1]

    big = 2**60 + 1
    latest = lambda name, rows: feed(streams.stream_latest, "id string, n long, ts timestamp", name, rows)
    got, _ = latest("a", [("x", big, at(0, 7)), ("x", 1, at(0, 6)), ("y", None, at(1)), ("z", 1, None)])
    assert [(r[0], r[1], r[2].microsecond) for r in got] == [("x", big, 7), ("y", None, 0)]
    # after a restart: what comes again or is older gives nothing, what is newer does
    got, _ = latest("b", [("x", big, at(0, 7)), ("y", 5, at(2)), ("x", 3, at(0))])
    assert [r[:2] for r in got] == [("y", 5)]
    got, held = latest("c", [("w", 1, at(1000))])
    assert [r[:2] for r in got] == [("w", 1)] and held == 1
    got, _ = latest("d", [("x", 9, at(5))])
    assert got == []

    progress = lambda name, rows: feed(streams.stream_progress, "job_id long, seq long, line string, ts timestamp", name, rows)
    assert progress("a", [(1, 5, "=== 2/4 x", at(0)), (1, 1, "=== 1/4 x", at(0)), (1, 6, "page 7: ok", at(1))])[0] == [(1, 50, 7, 3)]
    # a stage that comes after a later one doesn't set the progress back
    assert progress("b", [(1, 3, "=== 1/4 x", at(2)), (1, 8, "page 2: ok", at(2))])[0] == [(1, 50, 7, 5)]
    assert progress("c", [(2, 1, None, at(1000))]) == ([(2, 0, 0, 1)], 1)
    assert progress("d", [(1, 9, "=== 3/4 x", at(4))])[0] == []


def test_sweep_deletes_once(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n, tzinfo=dt.UTC)
    done = [(1, "done", day(1)), (2, "failed", day(5)), (3, "running", None), (4, "done", day(20)), (1, "done", day(1))]
    read = lambda: spark.createDataFrame(done, "id long, status string, finished_at timestamp")
    ledger, cp, ticks = (str(tmp_path / n) for n in ("ledger", "cp", "ticks"))

    def run(n):
        spark.createDataFrame([(day(n),)], "ts timestamp").coalesce(1).write.mode("append").parquet(ticks)
        streams.stream_retention(spark.readStream.schema("ts timestamp").parquet(ticks), read, ledger, cp, 7).start().awaitTermination()
        return sorted((r.id, r.batch) for r in spark.read.schema("id long, batch long").parquet(ledger).collect())

    assert run(9) == [(1, 0)]
    assert run(14) == [(1, 0), (2, 1)]
    # the same batch again, as after a failure
    streams.sweep_batch(read, ledger, 7)(spark.createDataFrame([(day(14),)], "ts timestamp"), 1)
    assert sorted((r.id, r.batch) for r in spark.read.schema("id long, batch long").parquet(ledger).collect()) == [(1, 0), (2, 1)]
    assert run(30) == [(1, 0), (2, 1), (4, 2)]
