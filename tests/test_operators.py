"""Operators without a SQL twin, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import consensus, greedy, graph, islands, jobs, quality, repeat, slots, spatial

BOX = "page_id long, idx long, x1 int, y1 int, x2 int, y2 int"


def boxes(seed, pages=12, most=14):
    rng = random.Random(seed)
    out = []
    for p in range(pages):
        for i in range(rng.randint(0, most)):
            x, y = rng.randrange(-20, 200), rng.randrange(0, 200)
            out.append((p, i, x, y, x + rng.randrange(0, 120), y + rng.randrange(0, 120)))
    return out


def overlap(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


def area(a):
    return (a[4] - a[2]) * (a[5] - a[3])


@pytest.mark.parametrize("cell", [16, 128])
def test_box_pairs_meet_once(spark, cell):
    rows = boxes(1)
    df = spark.createDataFrame(rows, BOX)
    got = sorted((r.page_id, r.idx_a, r.idx_b) for r in spatial.box_pairs(df, df, margin=7, cell=cell).collect())
    touch = lambda a, b: b[2] <= a[4] + 7 and b[4] >= a[2] - 7 and b[3] <= a[5] + 7 and b[5] >= a[3] - 7
    assert got == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and touch(a, b))


def test_greedy_suppress_is_the_sequential_pass(spark):
    rows = boxes(2, pages=20)
    df = spark.createDataFrame(rows, BOX).withColumn("order", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) * -1)
    pairs = [(a[0], a[1], b[0], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and overlap(a, b) > 0]
    got = greedy.greedy_suppress(df, spark.createDataFrame(pairs, "page_id_a long, idx_a long, page_id_b long, idx_b long"), ["page_id", "idx"], ["order"])
    kept = []
    for r in sorted(rows, key=lambda r: (-area(r), r[0], r[1])):
        if not any(k[0] == r[0] and overlap(k, r) > 0 for k in kept):
            kept.append(r)
    assert sorted((r.page_id, r.idx) for r in got.collect()) == sorted(k[:2] for k in kept)


@pytest.mark.parametrize("n, held", [(10_000, 100_000), (18, 4)])
def test_greedy_suppress_of_falling_chains(spark, n, held):
    """Every box conflicts with the next one: each second stays, also where a component is too long for one task."""
    chains = [("a", i) for i in range(n)] + [("b", i) for i in range(7)] + [("c", 0)]
    df = spark.createDataFrame([(p, i, i) for p, i in chains], "page string, idx long, order long")
    links = df.select(F.col("page").alias("page_a"), F.col("idx").alias("idx_a"), F.col("page").alias("page_b"), (F.col("idx") + 1).alias("idx_b"))
    got = greedy.greedy_suppress(df, links, ["page", "idx"], ["order"], rounds=2, held=held)
    assert sorted((r.page, r.idx) for r in got.collect()) == sorted((p, i) for p, i in chains if i % 2 == 0)


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(100, 101), (102, 101), (101, 101), (5, 5), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, 100: 100, 101: 100, 102: 100}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_colours_differ_and_pages_cross_batches(spark):
    rows = boxes(3, pages=40)
    near = [(a[0], a[1], [b[1] for b in rows if b[0] == a[0] and b[1] != a[1] and overlap(a, b) > 0]) for a in rows]
    df = spark.createDataFrame(rows, BOX).join(spark.createDataFrame(near, "page_id long, idx long, conflicts array<long>"), ["page_id", "idx"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r.page_id, r.idx): r.colour for r in greedy.greedy_colour(df, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    assert all(got[p, i] != got[p, j] for p, i, other in near for j in other)


def test_components_capped(spark):
    rows = [(1, 0, 10.0, [1]), (1, 1, 15.0, [2]), (1, 2, 20.0, []), (2, 0, 5.0, None)]
    got = greedy.components_capped(spark.createDataFrame(rows, "page_id long, idx long, size double, partners array<long>"))
    assert sorted((r.page_id, r.idx, r.new_size) for r in got.collect()) == [(1, 0, 10.0), (1, 1, 10.0), (1, 2, 20.0), (2, 0, 5.0)]


def test_fuzzy_group(spark):
    rows = [(1, 0, 0, True, 10, 10, 10, 20), (1, 1, 0, True, 30, 10, 10, 24), (1, 2, 0, True, 60, 10, 10, 24), (1, 3, 1, True, 10, 10, 10, 20)]
    got = greedy.fuzzy_group(spark.createDataFrame(rows, "page_id long, idx long, bucket int, cjk boolean, r int, g int, b int, height int"))
    assert sorted((r.idx, r.seed) for r in got.collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_folds_against_loops(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.randrange(300))) for k in range(6) for _ in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "k long, v double")
    mean, half = {}, {}
    for k in range(6):
        a, b = [], []
        for v in sorted(x for kk, x in rows if kk == k):
            if a and abs(v - sum(a[-1]) / len(a[-1])) <= 12:
                a[-1].append(v)
            else:
                a.append([v])
            if b and abs(v - b[-1][0]) <= 12:
                b[-1] = ((b[-1][0] + v) / 2, b[-1][1] + 1)
            else:
                b.append((v, 1))
        mean.update({(k, i): (sum(x) / len(x), len(x)) for i, x in enumerate(a)})
        half.update({(k, i): x for i, x in enumerate(b)})
    for got, want in ((islands.row_cluster(df, ["k"], "v", 12), mean), (islands.avg2_cluster(df, ["k"], "v", 12), half)):
        assert {(r.k, r.cluster): (pytest.approx(r.centre), r.n) for r in got.collect()} == want


def test_sliding_limit_counts_only_accepted(spark):
    rows = [(1, i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 10, 20, 30, 59])] + [(1, 9, "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: (r.accepted, r.retry_after) for r in jobs.sliding_limit(df, 2).collect()}
    assert got == {0: (True, 0.0), 1: (True, 0.0), 2: (False, 40.0), 3: (False, 30.0), 4: (False, 1.0), 9: (True, 0.0)}


def test_sliding_limit_equals_the_loop(spark):
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, 1_700_000_000 + rng.randrange(0, 900) + rng.choice([0.0, 0.5])) for i in range(500)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t double").select("user_id", "event_id", F.timestamp_seconds("t").alias("ts"))
    want = {}
    for user in (1, 2, None):
        kept = []
        for _, i, t in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            recent = [x for x in kept if x > t - 60]
            want[i] = (len(recent) < 3, 0.0 if len(recent) < 3 else recent[0] + 60 - t)
            if want[i][0]:
                kept.append(t)
    assert {r.event_id: (r.accepted, r.retry_after) for r in jobs.sliding_limit(df, 3).collect()} == want


def test_fuzzy_group_takes_the_first_like_seed(spark):
    rng = random.Random(12)
    rows = [(p, i, i % 2, False, rng.randrange(0, 120), rng.randrange(0, 60), 0, rng.randrange(8, 20)) for p in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, idx long, bucket int, cjk boolean, r int, g int, b int, height int")
    want = {}
    for p in range(6):
        seeds = []
        for r in (r for r in rows if r[0] == p):
            like = [s for s in seeds if s[2] == r[2] and max(abs(s[4] - r[4]), abs(s[5] - r[5])) <= 25 and max(s[7], r[7]) <= 1.25 * min(s[7], r[7])]
            want[p, r[1]] = like[0][1] if like else r[1]
            if not like:
                seeds.append(r)
    assert {(r.page_id, r.idx): r.seed for r in greedy.fuzzy_group(df).collect()} == want


def test_long_chains(spark):
    rng = random.Random(13)
    order = rng.sample(range(400), 400)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1001), (None, 5)], "src long, dst long")  # noqa: B905
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {**{n: 0 for n in range(400)}, 1000: 1000, 1001: 1000}
    assert graph.components(links.limit(0)).count() == 0


def test_slides_of_several_decks(spark):
    deck = lambda name, n, width: spark.createDataFrame([(name, i, None, None, None, width, 9, "w") for i in range(n)], "file string, slide int, width int, height int, background string, deck_width int, deck_height int, deck_background string")
    got = slots.combine_layouts(deck("b", 3, 20), deck("a", 2, 10)).orderBy("position").collect()
    assert [(r.position, r.file, r.slide, r.width) for r in got] == [(1, "a", 0, 10), (2, "a", 1, 10), (3, "b", 0, 10), (4, "b", 1, 10), (5, "b", 2, 10)]


def test_worst_regions_do_not_overlap(spark):
    pts = [(1, x, y, v) for x, y, v in [(10, 10, 50), (90, 90, 40), (400, 400, 30), (410, 420, 20), (900, 10, 1)]]
    got = quality.worst_regions(spark.createDataFrame(pts, "k long, x int, y int, v int"), ["k"]).collect()
    tiles = [(r.tx, r.ty) for r in got]
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and tiles[0] == (0, 0)
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) >= 2 for i, a in enumerate(tiles) for b in tiles[:i])


def test_cross_verify_cases(spark):
    cases = [
        (("", "", None), (0, 0, 0), "C_all_empty", ""),
        (("Ab c", "abc", "ABC"), (0.1, 0.1, 0.1), "A_strict_consensus", "Ab c"),
        (("xyz", "abc", "ABC"), (0.9, 0.2, 0.3), "B_majority", "ABC"),
        (("abcd", "abce", "abcf"), (0.5, 0.4, 0.3), "D_edit_close", "abcf"),
        (("这是文字", "qq", "zzzz9"), (0.96, 0.97, 0.2), "D_prime_single_high_conf", "这是文字"),
        (("这是文字", "qq", "zzzz9"), (0.86, 0.1, 0.2), "G_moderate_conf_fallback", "这是文字"),
        (("这是文字", "qq", "zzzz9"), (0.2, 0.3, 0.25), "F_disagree", "qq"),
    ]
    rows = [(i, *t, *map(float, c)) for i, (t, c, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i long, t1 string, t2 string, t3 string, c1 double, c2 double, c3 double")
    got = {r.i: (r.reason, r.suggested_text) for r in consensus.cross_verify(df).collect()}
    assert got == {i: (c[2], c[3]) for i, c in enumerate(cases)}


def test_template_repeat_ratio_rounds_half_to_even(spark):
    rows = [(p, p, "same", 5, 5) for p in range(2)] + [(p, 9, f"own {p}", 0, 0) for p in range(5)]
    df = spark.createDataFrame(rows, "page_id long, idx long, text string, cx int, cy int")
    got = repeat.template_repeat(df, min_pages=1, min_ratio=0.5, tolerance=0, max_length=10).collect()  # round(2.5) = 2
    assert [(r.text, r.pages, r.total_pages) for r in got] == [("same", 2, 5)]


def test_slot_classes_and_sizes(spark):
    texts = [(1, i, 10, i * 30, 60, i * 30 + 20, 0, s, i != 3, "left") for i, s in enumerate([20, 21, 22, 60])]
    df = spark.createDataFrame(texts, BOX + ", style int, size int, bold boolean, align string")
    contains = spark.createDataFrame([(1, i, 99, 5000) for i in range(4)], "page_id long, text_idx long, container_idx long, area long")
    edges = slots.pair_edges(df, contains)
    assert {(r.a, r.b) for r in edges.collect()} == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    got = {r.idx: (r.new_size, r.bold) for r in slots.size_class(df, slots.slot_classes(edges)).collect()}
    assert got == {0: (22, True), 1: (22, True), 2: (22, True), 3: (60, True)}
