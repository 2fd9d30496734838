"""Scores of texts and pages, and their comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.greedy import greedy_suppress

#: How far a metric may fall before it counts as a regression.
TOLERANCES = {"composite": 0.01, "blurred": 0.02, "histogram": 0.03, "recall": 0.01}
#: Weights of the composite score.
WEIGHTS = {"blurred": 0.30, "histogram": 0.10, "recall": 0.30, "cer_inverse": 0.20, "counts": 0.10}


def plain(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def keyword_recall(docs: DataFrame, keywords: DataFrame, key: list[str], text: str = "text", word: str = "keyword") -> DataFrame:
    """(key, found, expected, recall, missing): keywords that the document's text holds, white space left aside.

    ``keywords``: key, keyword. A key without a document finds nothing.
    """
    rows = keywords.groupBy(*key).agg(F.array_sort(F.collect_set(word)).alias("wanted"))
    both = rows.join(docs.select(*key, plain(F.coalesce(text, F.lit(""))).alias("__t")), key, "left")
    held = F.filter("wanted", lambda w: F.contains(F.coalesce("__t", F.lit("")), plain(w)))
    return both.withColumn("__f", held).select(*key, F.size("__f").alias("found"), F.size("wanted").alias("expected"), (F.size("__f") / F.greatest(F.size("wanted"), F.lit(1))).alias("recall"), F.array_except("wanted", "__f").alias("missing"))


def cer(text: Column, reference: Column) -> Column:
    """Edits per character of the reference, white space left aside; null without a reference."""
    t, r = plain(text), plain(reference)
    return F.when(F.length(r) > 0, F.levenshtein(r, t) / F.length(r))


def extra_ratio(text: Column, reference: Column) -> Column:
    """Share of characters that the reference doesn't have."""
    t, r = plain(text), plain(reference)
    return F.when(F.length(r) > 0, F.length(F.call_function("translate", t, r, F.lit(""))) / F.greatest(F.length(t), F.lit(1)))


def in_range(value: Column, low: Column, high: Column) -> Column:
    return value.between(low, high)


def composite(ok: Column, blurred: Column, histogram: Column, recall: Column, cer: Column, textbox_ok: Column, image_ok: Column) -> Column:
    """Weighted score from 0 to 1 in four digits; 0 if the structure is broken; recall stands in for a missing cer."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    flag = lambda c: F.when(c, 0.5).otherwise(0.0)
    parts = {
        "blurred": zero(blurred),
        "histogram": F.greatest(F.lit(0.0), zero(histogram)),
        "recall": zero(recall),
        "cer_inverse": F.coalesce(1.0 - cer, zero(recall)),
        "counts": flag(textbox_ok) + flag(image_ok),
    }
    total = sum(parts[k] * w for k, w in WEIGHTS.items())
    return F.when(ok, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)).otherwise(F.lit(0.0))


def structural_qa(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, slides, media, runs, placeholders, empty_media, failures, ok).

    ``parts``: key, kind (slide, media, run), size, placeholder.
    """
    agg = parts.groupBy(*key).agg(
        F.count_if(F.col("kind") == "slide").alias("slides"),
        F.count_if(F.col("kind") == "media").alias("media"),
        F.count_if(F.col("kind") == "run").alias("runs"),
        F.count_if((F.col("kind") == "run") & F.col("placeholder")).alias("placeholders"),
        F.count_if((F.col("kind") == "media") & (F.col("size") == 0)).alias("empty_media"),
    )
    failures = F.array_compact(
        F.array(
            F.when(F.col("slides") == 0, "no slides"),
            F.when(F.col("runs") == 0, "no text"),
            F.when(F.col("placeholders") > 0, "placeholder text"),
            F.when(F.col("empty_media") > 0, "empty media"),
        )
    )
    return agg.withColumn("failures", failures).withColumn("ok", F.size("failures") == 0)


def baseline_compare(now: DataFrame, before: DataFrame, key: str = "fixture", tolerances: dict[str, float] = TOLERANCES) -> DataFrame:
    """(key, status, composite_now, composite_prev, regressions, improvements).

    FAILED if not ok, NEW without a baseline, REGRESSED if any metric fell by
    more than its tolerance, IMPROVED if any rose by more, else UNCHANGED; the
    lists name the metrics in the order of the tolerances. ``now`` has ``ok``.
    """
    prev = before.select(key, *[F.col(m).alias(f"__{m}") for m in tolerances], F.lit(True).alias("__old"))
    both = now.join(prev, key, "left")
    delta = {m: F.col(m) - F.col(f"__{m}") for m in tolerances}
    named = lambda test: F.array_compact(F.array(*[F.when(test(m, t), m) for m, t in tolerances.items()]))
    compared = F.col("ok") & F.col("__old").isNotNull()
    none = F.array().cast("array<string>")
    both = both.withColumns(
        {
            "regressions": F.when(compared, named(lambda m, t: delta[m] < -t)).otherwise(none),
            "improvements": F.when(compared, named(lambda m, t: delta[m] > t)).otherwise(none),
        }
    )
    status = F.when(~F.col("ok"), "FAILED").when(F.col("__old").isNull(), "NEW").when(F.size("regressions") > 0, "REGRESSED").when(F.size("improvements") > 0, "IMPROVED").otherwise("UNCHANGED")
    return both.select(key, status.alias("status"), F.col("composite").alias("composite_now"), F.when(F.col("ok"), F.col("__composite")).alias("composite_prev"), "regressions", "improvements")


def deltas_long(now: DataFrame, before: DataFrame, key: str = "fixture", tolerances: dict[str, float] = TOLERANCES) -> DataFrame:
    """A row a fixture and metric that both have: (key, metric, prev, now, delta)."""
    long = lambda df, name: df.unpivot([key], list(tolerances), "metric", name)
    both = long(now, "now").join(long(before, "prev"), [key, "metric"])
    return both.where("now is not null and prev is not null").select(key, "metric", "prev", "now", F.round(F.col("now") - F.col("prev"), 4).alias("delta"))


def suite_summary(compared: DataFrame) -> DataFrame:
    """One row: mean now over all, mean before over those with a baseline, their difference, and counts.

    The two means are of different sets; that asymmetry is kept.
    """
    agg = compared.agg(
        F.count("*").alias("fixtures"),
        F.avg("composite_now").alias("avg_now"),
        F.avg("composite_prev").alias("avg_prev"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "REGRESSED").alias("regressed"),
        F.count_if(F.col("status") == "IMPROVED").alias("improved"),
    )
    return agg.withColumn("delta", F.col("avg_now") - F.col("avg_prev")).withColumn("exit_status", ((F.col("failed") + F.col("regressed")) > 0).cast("int"))


def match_ratio(a: Column, b: Column, within: float) -> Column:
    """Share of positions of two arrays that differ by ``within`` at most."""
    close = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= within)
    return F.size(close) / F.greatest(F.size(a), F.lit(1))


def histogram(values: Column, low: float, high: float, bins: int = 16) -> Column:
    """Counts of an array's values by equal bins; those beyond the ends count in the outer bins."""
    place = lambda v: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - low) * bins / (high - low)))).cast("int")
    at = F.transform(values, place)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of two arrays of one length; 0 if either doesn't vary."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    times = lambda x, y: total(F.zip_with(x, y, lambda u, v: u * v))
    sa, sb = total(a), total(b)
    va, vb = n * times(a, a) - sa * sa, n * times(b, b) - sb * sb
    return F.when((va > 0) & (vb > 0), (n * times(a, b) - sa * sb) / F.sqrt(va * vb)).otherwise(F.lit(0.0))


def tile_means(points: DataFrame, key: list[str], size: int = 160, stride: int = 80, least: float = 5) -> DataFrame:
    """Sliding square tiles with the mean of their points, ``least`` or more: (key, tx, ty, mean, n).

    A point lies in (size / stride) squared tiles; ``points``: key, x, y, v.
    """
    k = size // stride
    tiles = lambda v: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.floor(F.col(v) / stride) - i).cast("int"))
    dealt = points.withColumn("tx", F.explode(tiles("x"))).withColumn("ty", F.explode(tiles("y"))).where("tx >= 0 and ty >= 0")
    return dealt.groupBy(*key, "tx", "ty").agg(F.avg("v").alias("mean"), F.count("*").alias("n")).where(F.col("mean") >= least)


def worst_regions(points: DataFrame, key: list[str], top: int = 3, size: int = 160, stride: int = 80, least: float = 5) -> DataFrame:
    """The ``top`` tiles of each key by mean that don't overlap a better one: (key, rank, tx, ty, mean)."""
    tiles = tile_means(points, key, size, stride, least).withColumn("order", -F.col("mean"))
    k = size // stride
    name = [*key, "tx", "ty"]
    a = tiles.select(*key, *[F.col(c).alias(f"{c}_a") for c in ("tx", "ty")], F.explode(F.sequence(F.col("tx") - k + 1, F.col("tx") + k - 1)).alias("tx_b"))
    a = a.withColumn("ty_b", F.explode(F.sequence(F.col("ty_a") - k + 1, F.col("ty_a") + k - 1))).where("tx_a <> tx_b or ty_a <> ty_b")
    pairs = a.join(tiles.select(*key, F.col("tx").alias("tx_b"), F.col("ty").alias("ty_b")), [*key, "tx_b", "ty_b"])
    pairs = pairs.select(*[F.col(c).alias(f"{c}_a") for c in key], "tx_a", "ty_a", *[F.col(c).alias(f"{c}_b") for c in key], "tx_b", "ty_b")
    kept = greedy_suppress(tiles, pairs, name, ["order"])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("mean"), "tx", "ty"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select(*key, "rank", "tx", "ty", "mean")


def cause_guess(edges: Column, edges_now: Column, colour_delta: Column, spread: Column, spread_now: Column) -> Column:
    """Ordered reasons for a difference, from edge density, mean colour and the deviation of brightness before and now.

    lost or flattened: fewer edges; added or larger: more; colour: the mean
    colour moved by more than 25 (with the amount); filled: nearly one colour now.
    Without any: shifted from an edge delta of 1.5 on, else rendering.
    """
    delta, flat = F.abs(edges - edges_now), F.abs(spread - spread_now)
    reasons = F.array_compact(
        F.array(
            F.when((delta > 4) & (edges_now < edges), "lost").when((delta > 4) & (edges_now > edges), "added"),
            F.when(colour_delta > 25, F.concat(F.lit("colour "), F.bround(colour_delta, 0).cast("int"))),
            F.when((flat > 25) & (spread_now < spread), "filled"),
        )
    )
    return F.when(F.size(reasons) > 0, reasons).when(delta > 1.5, F.array(F.lit("shifted"))).otherwise(F.array(F.lit("rendering")))
