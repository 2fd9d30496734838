"""Finishing passes against plain loops."""

import random
import statistics

from pyspark.sql import functions as F

from quire.operators import consensus, finishing, islands, quality


def test_median_mean_and_halfway_clusters(spark):
    rng = random.Random(1)
    rows = [(k, i, float(rng.randrange(0, 300))) for k in range(12) for i in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "k int, idx int, v double")
    want, means, halves = {}, {}, {}
    for k in range(12):
        values = sorted(v for q, _, v in rows if q == k)
        groups, rows_, half = [[values[0]]], [[values[0]]], [[values[0], 1]]
        for v in values[1:]:
            groups[-1].append(v) if abs(v - statistics.median(groups[-1])) <= 11 else groups.append([v])
            rows_[-1].append(v) if abs(v - statistics.mean(rows_[-1])) <= 11 else rows_.append([v])
            if abs(v - half[-1][0]) <= 11:
                half[-1] = [(half[-1][0] + v) / 2, half[-1][1] + 1]
            else:
                half.append([v, 1])
        want[k] = sorted((c, v) for c, g in enumerate(groups) for v in g)
        means[k] = [(c, statistics.mean(g), len(g)) for c, g in enumerate(rows_)]
        halves[k] = [(c, *h) for c, h in enumerate(half)]
    got = islands.median_cluster(df, ["k"], "v", 11).collect()
    assert {k: sorted((r.cluster, r.v) for r in got if r.k == k) for k in range(12)} == want
    for f, plain in ((islands.row_cluster, means), (islands.avg2_cluster, halves)):
        got = f(df, ["k"], "v", 11).collect()
        found = {k: sorted((r.cluster, round(r.centre, 6), r.n) for r in got if r.k == k) for k in range(12)}
        assert found == {k: [(c, round(m, 6), n) for c, m, n in v] for k, v in plain.items()}
    assert islands.median_cluster(df.limit(0), ["k"], "v", 11).count() == 0


def clusters(values, gap):
    out = []
    for v in sorted(values):
        out[-1].append(v) if out and v - out[-1][-1] <= gap else out.append([v])
    return out


def plain_snap(texts, scopes):
    """Scopes from the smallest: columns of labels in a scope of rows and columns take their modal left edge."""
    new, done = {t[0]: float(t[1]) for t in texts}, set()
    for _, members in sorted(scopes.items()):
        inside = [t for t in texts if t[0] in members]
        rows = []
        for cy in sorted((t[2] + t[4]) / 2 for t in inside):
            if rows and abs(cy - rows[-1]) <= 10:
                rows[-1] = (rows[-1] + cy) / 2
            else:
                rows.append(cy)
        if len(inside) < 6 or len(rows) < 3 or max(t[1] for t in inside) - min(t[1] for t in inside) < 90:
            continue
        columns = []
        for t in sorted((t for t in inside if t[5] and t[0] not in done), key=lambda t: t[1]):
            columns[-1].append(t) if columns and abs(t[1] - statistics.median([o[1] for o in columns[-1]])) <= 34 else columns.append([t])
        for column in columns:
            if len(column) < 3:
                continue
            xs, cys, ws = [t[1] for t in column], [(t[2] + t[4]) / 2 for t in column], [t[3] - t[1] for t in column]
            tall = statistics.median([t[4] - t[2] for t in column])
            if max(cys) - min(cys) <= 1.6 * tall or len(clusters(cys, max(8, 0.45 * tall))) < 3 or max(xs) - min(xs) > 34 or max(ws) / min(ws) > 1.75:
                continue
            tight = clusters(xs, 7)
            best = max((c for c in tight if len(c) >= max(2, max(map(len, tight)) - 1)), key=lambda c: (len(c), statistics.median(c)), default=None)
            if best is None:
                continue
            target = round(statistics.median(best), 3)
            moved = [t for t in column if 0.15 <= abs(t[1] - target) <= 34]
            for t in moved:
                new[t[0]] = target
            if moved:
                done |= {t[0] for t in column}
    return new


def test_table_column_snap(spark):
    rng = random.Random(2)
    texts, contains, want = [], [], {}
    for page in range(15):
        mine = []
        for i in range(rng.randrange(6, 26)):
            x, y = rng.choice([20, 120, 220]) + rng.choice([0, 0, 0, 1, 4, -9, 15]), rng.randrange(0, 8) * 22
            mine.append((i, x, y, x + rng.choice([40, 50, 60]), y + 16, rng.random() < 0.85))
        scopes = {a: {t[0] for t in mine if rng.random() < share} for a, share in ((1, 0.5), (2, 0.7), (3, 1.0))}
        texts += [(page, *t) for t in mine]
        contains += [(page, i, a, a) for a, s in scopes.items() for i in s]
        want[page] = plain_snap(mine, scopes)
    df = spark.createDataFrame(texts, "page_id long, idx long, x1 int, y1 int, x2 int, y2 int, label boolean")
    of = spark.createDataFrame(contains, "page_id long, text_idx long, container_idx long, area long")
    got = finishing.table_column_snap(df, of).collect()
    assert {(r.page_id, r.idx): r.new_x for r in got} == {(p, i): x for p, m in want.items() for i, x in m.items()}
    assert any(r.new_x != r.x1 for r in got)


def plain_runs(chars, line, tolerance=40):
    near = lambda a, b: all(abs(x - y) <= tolerance for x, y in zip(a, b, strict=True))
    runs = []
    for ch, colour in chars:
        if runs and (colour is None or runs[-1][1] is None or near(colour, runs[-1][1])):
            runs[-1] = (runs[-1][0] + ch, runs[-1][1] or colour)
        else:
            runs.append((ch, colour))
    out = []
    for text, colour in ((t, c or line) for t, c in runs):
        seen = sum(1 for c in text if c.strip())
        if colour != line and seen < 2:
            if out:
                out[-1] = (out[-1][0] + text, out[-1][1])
            else:
                out.append((text, line))
        elif out and out[-1][1] == colour:
            out[-1] = (out[-1][0] + text, colour)
        else:
            out.append((text, colour))
    return out


def test_runs_of_like_colour(spark):
    rng = random.Random(3)
    palette = [None, (0, 0, 0), (30, 30, 30), (60, 60, 60), (200, 0, 0), (0, 0, 255)]
    lines = [[(rng.choice("ab c1"), rng.choice(palette)) for _ in range(rng.randrange(0, 15))] for _ in range(80)]
    rows = [(i, [(c, *(v or (None,) * 3)) for c, v in line], 0, 0, 0) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "k int, chars array<struct<ch:string,r:int,g:int,b:int>>, r int, g int, b int")
    got = {r.k: [(x.text, (x.r, x.g, x.b)) for x in r.runs] for r in finishing.fuzzy_rle(df, ["k"]).collect()}
    assert got == {i: plain_runs(line, (0, 0, 0)) for i, line in enumerate(lines)}


def test_ruled_grids(spark):
    rows = []
    for page, (n, step, verticals) in enumerate([(5, 30, 5), (3, 30, 5), (5, 70, 5), (5, 30, 3)]):
        rows += [(page, i, 10.0, 20.0 + step * i, 400.0, 22.0 + step * i, True) for i in range(n)]
        rows += [(page, 50 + i, 10.0 + 90 * i, 20.0, 12.0 + 90 * i, 20.0 + step * (n - 1), False) for i in range(verticals)]
    df = spark.createDataFrame(rows, "page_id long, idx long, x1 double, y1 double, x2 double, y2 double, horizontal boolean")
    assert [tuple(r) for r in finishing.ruled_candidates(df).collect()] == [(0, 10.0, 20.0, 400.0, 142.0, 4, 4)]


def test_finalizers_go_in_order(spark):
    texts = spark.createDataFrame([(1, 0, 10.0, 30.0, 10, True, "left"), (1, 1, 20.0, 40.0, 12, True, "left"), (1, 2, 0.0, 9.0, 30, False, "right")], "page_id long, idx int, x1 double, x2 double, size int, bold boolean, align string")
    classes = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "page_id long, idx int, class_idx int")
    got = sorted((r.idx, r.x1, r.x2, r["size"], r.align) for r in finishing.merge_finalizers(texts, classes).collect())
    assert got == [(0, 15.0, 35.0, 11, "left"), (1, 15.0, 35.0, 11, "left"), (2, 0.0, 9.0, 30, "right")]
    assert finishing.merge_finalizers(texts, classes, passes=()).drop("x").exceptAll(texts).count() == 0


def test_an_engine_is_preferred_by_script(spark):
    rows = [("汉字", 0.5, "汉", 0.99, "x", 0.9), ("汉字", 0.2, "汉子", 0.9, "", 0.0), ("word", 0.99, "ward", 0.9, "work", 0.5), ("word", 0.6, "ward", 0.9, "work", 0.2), ("", 0.1, "", 0.2, "", 0.3), ("é", 0.4, "e", 0.6, "é", 0.5)]
    df = spark.createDataFrame(rows, "t1 string, c1 double, t2 string, c2 double, t3 string, c3 double")
    best = consensus.pick_best(*[F.col(f"{n}{k}") for k in (1, 2, 3) for n in "tc"])
    assert [r.b.text for r in df.select(best.alias("b")).collect()] == ["汉字", "汉子", "work", "ward", "", "e"]


def test_cer_of_whole_turns(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    rows = [("".join(rng.choices("abé語 \n", k=rng.randrange(40))), "".join(rng.choices("abé語 \n", k=rng.randrange(40)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "t string, r string")
    for row in df.select("t", "r", quality.cer(F.col("t"), F.col("r")).alias("cer"), quality.extra_ratio(F.col("t"), F.col("r")).alias("extra")).collect():
        t, r = ("".join(s.split()) for s in (row.t, row.r))
        if not r:
            assert row.cer is None and row.extra is None
            continue
        assert abs(row.cer - edits(r, t) / len(r)) < 1e-9
        assert abs(row.extra - sum(c not in r for c in t) / max(1, len(t))) < 1e-9
