"""Fitting text to boxes: calibration, spacing, splitting into characters, best of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import DOUBLE_WIDTH
from quire.functions.values import clamp, log_ratio


def calibration_step(target: DataFrame, measured: DataFrame, key: list[str], max_shift: float = 12, deadband: float = 0.15, low: float = 0.82, high: float = 1.12) -> DataFrame:
    """(key, dx, dy, ratio): how far and by what factor a text must move and scale to meet its target.

    Both have key, box; a centred text (align = center, in ``target``) is
    compared by its centre. Shifts are bounded and within the deadband nothing;
    the ratio is the geometric mean of width and height ratios, bounded.
    """
    m = measured.select(*key, *[F.col(c).alias(f"m_{c}") for c in ("x1", "y1", "x2", "y2")])
    both = target.join(m, key)
    centre = F.col("align") == "center"
    dx = F.when(centre, (F.col("x1") + F.col("x2") - F.col("m_x1") - F.col("m_x2")) / 2.0).otherwise((F.col("x1") - F.col("m_x1")).cast("double"))
    dy = (F.col("y1") + F.col("y2") - F.col("m_y1") - F.col("m_y2")) / 2.0
    still = lambda d: F.when(F.abs(d) <= deadband, 0.0).otherwise(clamp(d, -max_shift, max_shift))
    ratio = log_ratio(F.col("x2") - F.col("x1"), F.col("m_x2") - F.col("m_x1"), 0.5, 2.0, 0.5) * log_ratio(F.col("y2") - F.col("y1"), F.col("m_y2") - F.col("m_y1"), 0.5, 2.0, 0.5)
    return both.select(*key, still(dx).alias("dx"), still(dy).alias("dy"), clamp(ratio, low, high).alias("ratio"))


def char_spacing(width: Column, room: Column, chars: Column, size: Column, least: float = -0.08) -> Column:
    """Tracking in points that makes a text fit: negative, bounded by a share of the size; 0 if it fits."""
    gaps = F.greatest(chars - 1, F.lit(1))
    return F.when(width <= room, 0.0).otherwise(F.greatest(least * size, (room - width) / gaps))


def char_boxes(boxes: DataFrame) -> DataFrame:
    """(page_id, idx, i, ch, x1, x2): a box split over its characters by their width; the outer edges are the box's."""
    unit = F.when(F.col("ch").rlike(f"[{DOUBLE_WIDTH}]"), 2).when(F.col("ch").rlike(r"\s"), 0.5).otherwise(1)
    rows = boxes.where("length(text) > 0").select("page_id", "idx", "x1", "x2", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("i", "ch")).withColumn("u", unit.cast("double"))
    of_box = Window.partitionBy("page_id", "idx")
    upto = F.sum("u").over(of_box.orderBy("i"))
    total, w = F.sum("u").over(of_box), F.col("x2") - F.col("x1")
    rows = rows.withColumns({"upto": upto, "total": total})
    return rows.select("page_id", "idx", "i", "ch", (F.col("x1") + w * (F.col("upto") - F.col("u")) / F.col("total")).alias("x1"), (F.col("x1") + w * F.col("upto") / F.col("total")).alias("x2"))


def argmin_grid(rows: DataFrame, key: list[str], low: int, high: int, cost: Column) -> DataFrame:
    """(key, best, cost): of whole sizes from low to high the one of least cost, of equals the smallest.

    ``cost`` may use the columns of ``rows`` and ``size``.
    """
    each = rows.withColumn("size", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("__cost", cost)
    best = F.min(F.struct("__cost", "size"))
    return each.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.size").alias("best"), F.col("b.__cost").alias("cost"))


def label_split(text: Column) -> Column:
    """struct<label, rest>: split before the first bracket, else after a colon with 2 to 14 characters before and 3 or more after; rest null if neither."""
    bracket = F.regexp_instr(text, F.lit("[(（]"))
    colon = F.regexp_extract(text, r"^([^:：]{2,14}[:：])\s*\S.{2,}$", 1)
    label = F.when(bracket > 1, F.substring(text, F.lit(1), bracket - 1)).when(colon != "", colon).otherwise(text)
    return F.struct(label.alias("label"), F.when((bracket > 1) | (colon != ""), F.substring(text, F.length(label) + 1, F.length(text))).alias("rest"))
