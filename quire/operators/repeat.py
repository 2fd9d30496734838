"""Texts that repeat across pages, and the review of single entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import strip, weighted_length


def _occurrences(boxes: DataFrame, max_length: int | None) -> DataFrame:
    rows = boxes.withColumn("text", strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    return rows if max_length is None else rows.where(weighted_length("text") <= max_length)


def repeat_candidates(boxes: DataFrame, max_length: int | None = None) -> DataFrame:
    """Texts on two pages or more: ``(text, pages, occurrences, x_range, y_range)``.

    ``boxes``: page_id, text, cx, cy (a centre; the line number, say, for both).
    Blank texts are ignored. Partial sums keep a text of very many pages cheap.
    """
    found = _occurrences(boxes, max_length).groupBy("text").agg(
        F.countDistinct("page_id").alias("pages"),
        F.count("*").alias("occurrences"),
        (F.max("cx") - F.min("cx")).alias("x_range"),
        (F.max("cy") - F.min("cy")).alias("y_range"),
    )
    return found.where("pages >= 2")


def template_repeat(boxes: DataFrame, min_pages: int = 2, min_ratio: float = 0.4, tolerance: float = 5, max_length: int = 60) -> DataFrame:
    """Texts at the same place of many pages: ``(text, pages, total_pages, med_x, med_y)``.

    A text must be on max(min_pages, min_ratio of all pages, rounded half to
    even) distinct pages; the centres of all its occurrences must lie within
    ``tolerance`` on both axes, and its weighted length within ``max_length``.
    Medians are cut to whole numbers.
    """
    rows = _occurrences(boxes, max_length)
    total = boxes.agg(F.countDistinct("page_id").alias("total_pages"))
    ranges = rows.groupBy("text").agg(F.countDistinct("page_id").alias("pages"), F.max("cx").alias("hx"), F.min("cx").alias("lx"), F.max("cy").alias("hy"), F.min("cy").alias("ly"))
    # medians only of the texts that qualify: a text of one place has few distinct centres
    kept = ranges.where((F.col("hx") - F.col("lx") <= tolerance) & (F.col("hy") - F.col("ly") <= tolerance)).crossJoin(F.broadcast(total))
    kept = kept.where(F.col("pages") >= F.greatest(F.lit(min_pages), F.bround(min_ratio * F.col("total_pages")).cast("long")))
    centre = rows.join(kept.select("text", "pages", "total_pages"), "text").groupBy("text", "pages", "total_pages")
    return centre.agg(F.percentile("cx", 0.5).cast("int").alias("med_x"), F.percentile("cy", 0.5).cast("int").alias("med_y"))


def whitelist_flag(boxes: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Boxes whose trimmed text is in ``whitelist`` (text); blank and comment lines of it count for nothing."""
    words = whitelist.select(strip("text").alias("__w")).where("__w <> '' and not startswith(__w, '#')").distinct()
    return boxes.join(words, strip("text") == F.col("__w"), "left_semi")


def flag_union(boxes: DataFrame, *flagged: DataFrame, name: str = "preserve_visual") -> DataFrame:
    """``boxes`` with a flag that is true where any of the sets has (page_id, idx)."""
    keys = [f.select("page_id", "idx") for f in flagged]
    both = keys[0]
    for k in keys[1:]:
        both = both.union(k)
    marked = boxes.drop(name).join(both.distinct().withColumn("__in", F.lit(True)), ["page_id", "idx"], "left")
    return marked.withColumn(name, F.coalesce("__in", F.lit(False))).drop("__in")


def counts_rollup(rows: DataFrame, page: str, kind: str) -> DataFrame:
    """Counts by page and kind with all totals in one pass; a null key stands for all."""
    return rows.rollup(page, kind).agg(F.count("*").alias("n"))


def review_pending(entries: DataFrame) -> DataFrame:
    """Pages with open yellow or red entries: ``(page_id, yellow, red)``; the row of page_id null is the total.

    ``entries``: page_id, tier, rule (null where not cleared).
    """
    open_ = entries.where("rule is null and tier in ('yellow', 'red')")
    return open_.rollup("page_id").agg(F.count_if(F.col("tier") == "yellow").alias("yellow"), F.count_if(F.col("tier") == "red").alias("red"))


def review_topk(boxes: DataFrame, threshold: float = 0.95, limit: int = 50) -> DataFrame:
    """The least confident boxes of each page, ``limit`` at most; degenerate ones are dropped after the cut."""
    of_page = Window.partitionBy("page_id").orderBy("confidence", "idx")
    ranked = boxes.where(F.col("confidence") < threshold).withColumn("rank", F.row_number().over(of_page)).where(F.col("rank") <= limit)
    return ranked.where("x2 > x1 and y2 > y1")


def review_merge(items: DataFrame, review: DataFrame) -> DataFrame:
    """Items with the review's corrections; ``outcome`` says what was done.

    Joined on (page_id, idx); a box that differs is a mismatch and changes
    nothing, null keeps, an equal text confirms (confidence 1, flag cleared), an
    empty one blanks and marks as visual, any other replaces.
    """
    r = review.select("page_id", "idx", F.col("corrected_text").alias("__new"), *[F.col(c).alias(f"__{c}") for c in ("x1", "y1", "x2", "y2")], F.lit(True).alias("__has"))
    both = items.join(r, ["page_id", "idx"], "left")
    same = F.lit(True)
    for c in ("x1", "y1", "x2", "y2"):
        same = same & (F.col(c) == F.col(f"__{c}"))
    outcome = F.when(F.col("__has").isNull(), "unreviewed").when(~same, "mismatch").when(F.col("__new").isNull(), "skipped").when(F.col("__new") == F.col("text"), "confirmed").when(F.col("__new") == "", "blanked").otherwise("changed")
    out = both.withColumn("outcome", outcome)
    done = F.col("outcome").isin("confirmed", "blanked", "changed")
    keep = [c for c in items.columns if c not in ("text", "confidence", "preserve_visual")]
    flag = F.col("preserve_visual") if "preserve_visual" in items.columns else F.lit(False)
    return out.select(
        *keep,
        F.when(done, F.col("__new")).otherwise(F.col("text")).alias("text"),
        F.when(done, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("outcome") == "blanked", True).when(done, False).otherwise(flag).alias("preserve_visual"),
        "outcome",
    )


def override_join(boxes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Boxes with the last decision on the same page and box; ``decisions``: page_id, box, decision, pos."""
    last = decisions.where("decision is not null").groupBy("page_id", "x1", "y1", "x2", "y2").agg(F.max_by("decision", "pos").alias("decision"))
    return boxes.drop("decision").join(last, ["page_id", "x1", "y1", "x2", "y2"], "left")


def review_queue(boxes: DataFrame, definitive: list[str]) -> DataFrame:
    """Boxes whose reason is not definitive, numbered from 1 within their page, decision open."""
    of_page = Window.partitionBy("page_id").orderBy("idx")
    return boxes.where(~F.col("reason").isin(definitive)).withColumn("number", F.row_number().over(of_page)).withColumn("decision", F.lit(None).cast("string"))


def tier_of(conf: Column, high: float = 0.95, moderate: float = 0.85) -> Column:
    return F.when(conf >= high, "green").when(conf >= moderate, "yellow").otherwise("red")
