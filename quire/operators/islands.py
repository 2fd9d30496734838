"""Gaps and islands: runs of rows in an order, within a page or another key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gap_cluster(df: DataFrame, key: list[str], value: str, gap: Column | float, order: list[str] | None = None, name: str = "cluster") -> DataFrame:
    """Number the clusters of a sorted value from 0; a new one begins where the step is larger than ``gap``."""
    w = Window.partitionBy(*key).orderBy(value, *(order or []))
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w)).drop("__new")


def column_centres(df: DataFrame, key: list[str], value: str, gap: float = 20) -> DataFrame:
    """(key, cluster, centre, n): means of the clusters, rounded half to even."""
    return gap_cluster(df, key, value, gap).groupBy(*key, "cluster").agg(F.bround(F.avg(value)).cast("long").alias("centre"), F.count("*").alias("n"))


def interval_merge(df: DataFrame, key: list[str], low: str = "x1", high: str = "x2", gap: float = 0, least: float = 0) -> DataFrame:
    """Intervals joined where the next begins within ``gap`` of what came before: (key, low, high, n) of ``least`` length."""
    w = Window.partitionBy(*key).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(low) > reach + gap).cast("int"), F.lit(0))
    numbered = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    merged = numbered.groupBy(*key, "__run").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n")).drop("__run")
    return merged.where(F.col(high) - F.col(low) >= least)


def dedupe_overlap_row(df: DataFrame, key: list[str], slack: float = 4) -> DataFrame:
    """Left edges of a row's items; one that begins before what came before ends (less ``slack``) joins it."""
    w = Window.partitionBy(*key).orderBy("x1", "idx")
    reach = F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__reach", reach).where(F.coalesce("__reach", F.lit(-10_000)) <= F.col("x1") + slack).drop("__reach")


def gap_runs(df: DataFrame, key: list[str], pos: str, on: str, least: int = 1) -> DataFrame:
    """Stretches where a signal is off, of ``least`` positions, up to the last on: (key, start, stop)."""
    w = Window.partitionBy(*key).orderBy(pos)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    rows = df.withColumn("__run", F.col(pos) - F.row_number().over(Window.partitionBy(*key, on).orderBy(pos))).withColumn("__later", F.max(F.col(on).cast("int")).over(after))
    runs = rows.where(~F.col(on)).groupBy(*key, "__run").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("stop"), F.min(F.coalesce("__later", F.lit(0))).alias("__later"))
    return runs.where((F.col("__later") == 1) & (F.col("stop") - F.col("start") >= least)).drop("__run", "__later")


def xy_cut(boxes: DataFrame, gap_x: float, gap_y: float) -> DataFrame:
    """Blocks of a page: cut at gaps between columns, then each strip at gaps between rows; tight boxes.

    (page_id, strip, block, x1, y1, x2, y2, n).
    """
    across = Window.partitionBy("page_id").orderBy("x1", "x2", "idx")
    reach = F.max("x2").over(across.rowsBetween(Window.unboundedPreceding, -1))
    strips = boxes.withColumn("__n", F.coalesce((F.col("x1") - reach >= gap_x).cast("int"), F.lit(0))).withColumn("strip", F.sum("__n").over(across))
    down = Window.partitionBy("page_id", "strip").orderBy("y1", "y2", "idx")
    low = F.max("y2").over(down.rowsBetween(Window.unboundedPreceding, -1))
    blocks = strips.withColumn("__n", F.coalesce((F.col("y1") - low >= gap_y).cast("int"), F.lit(0))).withColumn("block", F.sum("__n").over(down))
    return blocks.groupBy("page_id", "strip", "block").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n"))


def band_filter(bands: DataFrame, key: list[str], share: float = 0.32, wide: float = 0.6) -> DataFrame:
    """Ink bands without the low but wide ones (rules and underlines): ``bands`` has height and span (0 to 1)."""
    tallest = F.max("height").over(Window.partitionBy(*key))
    return bands.withColumn("__tallest", tallest).where(~((F.col("height") <= share * F.col("__tallest")) & (F.col("span") >= wide))).drop("__tallest")


def rle_runs(df: DataFrame, key: list[str], pos: str, same: list[str], text: str = "text") -> DataFrame:
    """Neighbours that agree in ``same`` become one run: (key, run, same..., text, n)."""
    w = Window.partitionBy(*key).orderBy(pos)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    rows = df.withColumn("__new", (changed & ~first).cast("int")).withColumn("run", F.sum("__new").over(w))
    words = F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda s: s[text])
    return rows.groupBy(*key, "run", *same).agg(F.array_join(words, "").alias(text), F.count("*").alias("n"))


def nearest_fill(df: DataFrame, key: list[str], pos: str, value: str, missing: Column) -> DataFrame:
    """Missing rows take the value of the nearest that isn't; of two at one distance the larger. Adds ``filled``."""
    w = Window.partitionBy(*key).orderBy(pos)
    known = F.when(~missing, F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    back = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = df.withColumns({"__b": back, "__a": ahead})
    db, da = F.col(pos) - F.col("__b.p"), F.col("__a.p") - F.col(pos)
    near = (
        F.when(F.col("__b").isNull(), F.col("__a.v"))
        .when(F.col("__a").isNull() | (db < da), F.col("__b.v"))
        .when(da < db, F.col("__a.v"))
        .otherwise(F.greatest(F.col("__a.v"), F.col("__b.v")))
    )
    return rows.withColumn("filled", F.when(missing, F.coalesce(near, F.col(value))).otherwise(F.col(value))).drop("__b", "__a")


def _fold(df: DataFrame, key: list[str], value: str, tolerance: float, start: Column, step) -> DataFrame:
    """Sorted values folded to clusters: (key, cluster, c).

    A step of more than ``tolerance`` ends a cluster in any case, as the centre
    of sorted values is no further on than the last. So a key is cut there
    first, and one fold holds such a stretch only, never the whole key.
    """
    parts = gap_cluster(df.select(*key, F.col(value).cast("double").alias("__v")), key, "__v", tolerance, name="__part")
    values = F.array_sort(F.collect_list("__v"))
    folded = parts.groupBy(*key, "__part").agg(F.aggregate(values, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"]))).alias("__c"))
    rows = folded.select(*key, "__part", F.posexplode("__c").alias("__i", "c"))
    return rows.withColumn("cluster", F.row_number().over(Window.partitionBy(*key).orderBy("__part", "__i")) - 1).drop("__part", "__i")


def _folded(df: DataFrame, key: list[str], value: str, tolerance: float, centre, grown) -> DataFrame:
    """Values within ``tolerance`` of ``centre(cluster)`` make it ``grown(cluster, x)``; (key, cluster, centre, n)."""
    one = "struct<c:double,n:int>"
    state = f"struct<done:array<{one}>,now:{one}>"
    empty = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("now")).cast(state)
    new = lambda x: F.struct(x.alias("c"), F.lit(1).alias("n")).cast(one)

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"]
        joins = F.coalesce(F.abs(x - centre(now)) <= tolerance, F.lit(False))
        done = F.when(now.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(now)))
        more = F.struct(acc["done"].alias("done"), grown(now, x).cast(one).alias("now"))
        return F.when(joins, more).otherwise(F.struct(done.alias("done"), new(x).alias("now"))).cast(state)

    rows = _fold(df, key, value, tolerance, empty, step)
    return rows.select(*key, "cluster", centre(F.col("c")).alias("centre"), F.col("c.n").alias("n"))


def row_cluster(df: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Values within ``tolerance`` of the running mean of the current row: (key, cluster, centre, n)."""
    return _folded(df, key, value, tolerance, lambda c: F.try_divide(c["c"], c["n"]), lambda c, x: F.struct((c["c"] + x).alias("c"), (c["n"] + 1).alias("n")))


def avg2_cluster(df: DataFrame, key: list[str], value: str, tolerance: float = 10) -> DataFrame:
    """Values within ``tolerance`` of the last centre, which then moves half way: (key, cluster, centre, n)."""
    return _folded(df, key, value, tolerance, lambda c: c["c"], lambda c, x: F.struct(((c["c"] + x) / 2).alias("c"), (c["n"] + 1).alias("n")))


def median_cluster(df: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """``df`` with ``cluster``: a value joins while within ``tolerance`` of the median of the cluster so far.

    The cluster's values are a stretch of the sorted ones, so its median is
    looked up, not kept. Nulls are in no cluster and go.
    """
    rows = df.where(F.col(value).isNotNull())
    parts = gap_cluster(rows, key, value, tolerance, name="__part")
    values = F.array_sort(F.collect_list(F.col(value).cast("double")))
    state = "struct<start:int,starts:array<int>>"

    def step(acc: Column, i: Column) -> Column:
        s, x = acc["start"], lambda at: F.element_at("__values", at.cast("int"))
        # members are the places s .. i - 1, from 1
        median = (x(F.floor((s + i - 1) / 2)) + x(F.ceil((s + i - 1) / 2))) / 2
        far = F.coalesce((i > s) & (F.abs(x(i) - median) > tolerance), F.lit(False))
        return F.when(far, F.struct(i.alias("start"), F.concat(acc["starts"], F.array(i)).alias("starts"))).otherwise(acc).cast(state)

    first = F.struct(F.lit(1).alias("start"), F.array(F.lit(1)).alias("starts")).cast(state)
    starts = parts.groupBy(*key, "__part").agg(values.alias("__values")).withColumn("__starts", F.aggregate(F.sequence(F.lit(1), F.size("__values")), first, step)["starts"])
    low = starts.select(*key, "__part", F.transform("__starts", lambda i: F.element_at("__values", i)).alias("__low"), "__starts")
    order = Window.partitionBy(*key, "__part").orderBy(value)
    placed = parts.withColumn("__at", F.row_number().over(order)).join(low, [*key, "__part"])
    inner = placed.withColumn("__in", F.size(F.filter("__starts", lambda i: i <= F.col("__at"))))
    name = F.dense_rank().over(Window.partitionBy(*key).orderBy("__part", "__in")) - 1
    return inner.withColumn("cluster", name).select(*df.columns, "cluster")


def axis_vote(df: DataFrame, key: list[str], limit: float) -> DataFrame:
    """The axis (left, center, right) along which a group's boxes spread least, first on a tie, and its median if within ``limit``.

    (key, axis, spread, target): target null where the spread is larger.
    """
    axes = {"left": F.col("x1").cast("double"), "center": (F.col("x1") + F.col("x2")) / 2.0, "right": F.col("x2").cast("double")}
    aggs = []
    for v in axes.values():
        aggs += [(F.max(v) - F.min(v)), F.percentile(v, 0.5)]
    named = [a.alias(f"{n}_{k}") for (n, k), a in zip([(n, k) for n in axes for k in ("spread", "median")], aggs, strict=True)]
    out = df.groupBy(*key).agg(F.count("*").alias("n"), *named)
    best = F.least(*[F.struct(F.col(f"{n}_spread").alias("spread"), F.lit(i).alias("i"), F.lit(n).alias("axis"), F.col(f"{n}_median").alias("median")) for i, n in enumerate(axes)])
    return out.withColumn("b", best).select(*key, "n", "b.axis", "b.spread", F.when(F.col("b.spread") <= limit, F.col("b.median")).alias("target"))


def modal_median(df: DataFrame, key: list[str], value: str, width: float = 16, tolerance: float = 24, least: int = 3) -> DataFrame:
    """Median of the values within ``tolerance`` of the middle of the fullest bin; of all values if fewer than ``least`` are.

    Ties of bins go to the lower one. (key, centre, n).
    """
    bins = df.groupBy(*key, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    mode = bins.groupBy(*key).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    rows = df.join(mode, key).withColumn("near", F.abs(F.col(value) - (F.col("bin") + 0.5) * width) <= tolerance)
    agg = rows.groupBy(*key).agg(F.percentile(F.when(F.col("near"), F.col(value)), 0.5).alias("a"), F.percentile(value, 0.5).alias("b"), F.count_if("near").alias("n"))
    return agg.select(*key, F.when(F.col("n") >= least, F.col("a")).otherwise(F.col("b")).alias("centre"), "n")


def mode_in_group(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The value most rows of a group have, of equals the largest, joined to each row as ``dominant``."""
    top = df.groupBy(*key, value).agg(F.count("*").alias("__n")).groupBy(*key).agg(F.max_by(value, F.struct("__n", value)).alias("dominant"))
    return df.join(top, key)


def coeff_var(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Population deviation over mean; infinite where the mean isn't positive.

    Squares of whole numbers (int or shorter) are summed exactly: the deviation
    then doesn't hang on the order in which rows and partial sums meet.
    """
    mean, spread = F.avg(value), F.stddev_pop(value)
    if df.schema[value].dataType.simpleString() in ("tinyint", "smallint", "int"):
        v, n = F.col(value).cast("long"), F.count(value).cast("decimal(12,0)")
        total = F.sum(v).cast("decimal(19,0)")
        squares = (n * F.sum((v * v).cast("decimal(19,0)")) - total * total).cast("double")
        spread = F.sqrt(squares / F.count(value) / F.count(value))
    return df.groupBy(*key).agg(F.when(mean > 0, spread / mean).otherwise(F.lit(float("inf"))).alias("cv"), F.count("*").alias("n"))
