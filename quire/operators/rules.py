"""Ordered rules: the first that matches names the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import Box
from quire.functions.text import CJK_WIDE, strip
from quire.operators.spatial import neighbours

Rule = tuple[str, Column]

#: Words of marks that are no content.
LOGO_WORDS = ("UNIVERSITY", "UNNERTY", "INSTITUTE", "COLLEGE", "GROUP", "CORP", "LTD", "INC", "LAB", "LOGO")


def first_match(rules: list[Rule]) -> Column:
    """The name of the first rule that holds, null if none; a null condition doesn't hold."""
    return reduce(lambda chain, rule: chain.when(F.coalesce(rule[1], F.lit(False)), rule[0]), rules[1:], F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0]))


def noise_rules(text: Column, conf: Column, box: Box, width: Column, height: Column) -> list[Rule]:
    """What is most likely no text: marks, icons, strokes and fragments, by text, confidence and place."""
    w1 = lambda v: F.greatest(v, F.lit(1))
    rx, ry = box.cx / w1(width), box.cy / w1(height)
    h = w1(box.height)
    s = strip(text)
    cjk = s.rlike(f"[{CJK_WIDE}]")
    strip_or_side = (ry < 0.15) | (ry > 0.85) | (rx < 0.16) | (rx > 0.85)
    return [
        ("H1_logo_strip", text.rlike("|".join(LOGO_WORDS)) & strip_or_side),
        ("H2_single_cjk_lowconf", (F.length(s) == 1) & cjk & (conf < 0.55)),
        ("H3_punct_symbol_only", (s != "") & ~F.contains(s, F.lit("…")) & ~s.isin(".", "..") & ~s.rlike(r"[\p{L}\p{N}]") & (F.length(s) <= 4) & (conf < 0.80)),
        ("H4_arrow_dash_fragment", s.rlike("^[-=>→←↑↓·•]+$") & (F.length(s) <= 6) & (conf < 0.90)),
        ("H5_short_thin_lowconf", (s != "") & ~cjk & ~F.contains(s, F.lit("…")) & (s != ".") & (F.length(s) <= 8) & (h <= 15) & (conf < 0.95) & ~((rx > 0.95) & (ry > 0.92))),
        ("H6_logo_digits_top_corner", ~cjk & s.rlike("^[0-9OoDIlZ]{1,3}$") & (ry < 0.12) & ((rx > 0.80) | (rx < 0.15)) & (conf < 0.95)),
    ]


def autoclear(boxes: DataFrame, width: Column, height: Column, mode: str = "all") -> DataFrame:
    """``boxes`` with ``rule``, the noise rule that clears the row, or null.

    ``mode``: "all" looks at every row, "suggested" only where ``corrected_text``
    equals ``suggested_text``, "unset" only where ``corrected_text`` is null.
    """
    open_ = {"all": F.lit(True), "suggested": F.col("corrected_text").eqNullSafe(F.col("suggested_text")) if mode == "suggested" else None, "unset": F.col("corrected_text").isNull() if mode == "unset" else None}[mode]
    rule = first_match(noise_rules(F.col("text"), F.col("confidence"), Box.of(), width, height))
    return boxes.withColumn("rule", F.when(open_, rule))


def icon_rules(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``is_text`` and ``reason``, by the rules that need no pixels.

    A single character is isolated if no other box of the page is within 15
    (scaled) pixels in height and 100 in width; neighbours meet on grid cells.
    """
    s = strip(F.coalesce("text", F.lit("")))
    short = F.length(s) <= 2
    near = neighbours(boxes.where(F.length(strip("text")) > 0), 100, 15).select("page_id", "idx").withColumn("has_near", F.lit(True))
    joined = boxes.join(near, ["page_id", "idx"], "left")
    rules = [
        ("forced", F.coalesce("force_text", F.lit(False))) if "force_text" in boxes.columns else ("forced", F.lit(False)),
        ("preserve", (F.coalesce("preserve_visual", F.lit(False)) if "preserve_visual" in boxes.columns else F.lit(False)) | (s == "")),
        ("decor_binary", F.regexp_replace(s, r"[\s….]", "").rlike("^[01]{4,}$")),
        ("decor_symbol", s.rlike(r"^(\p{So})\1+$")),
        ("short_lowconf", short & (F.col("confidence") < 0.6)),
        ("isolated_char", (F.length(s) == 1) & F.col("has_near").isNull()),
    ]
    reason = F.coalesce(first_match(rules), F.lit("text"))
    return joined.withColumn("reason", reason).drop("has_near").withColumn("is_text", F.col("reason").isin("forced", "text"))
