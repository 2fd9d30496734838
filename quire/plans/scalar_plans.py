"""Queries over the scalar functions of boxes and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import values as V
from quire.operators import fitting
from quire.plans.catalogue import register
from quire.plans.views import view, with_views


@register(
    "box_scalars",
    with_views("li_boxes", select="""select page_id, idx, (x2 - x1) * (y2 - y1) as area, (x1 + x2) / 2.0 as cx, (y1 + y2) / 2.0 as cy, least(x2, 640) - least(x1, 640) as clamped, greatest(1, round_even(9 * (y2 * 1.0 / 720), 0)) as scaled,
x1 * least(1280.0 / 1000, 720.0 / 520) + (1280 - 1000 * least(1280.0 / 1000, 720.0 / 520)) / 2 as box_x, (x2 - x1) * 1.0 / (y2 - y1) >= 1.45 or (x2 - x1) * 1.0 / (y2 - y1) <= cast(0.69 as double) as native,
least(x2 - x1, y2 - y1) >= 24 and (x2 - x1) * (y2 - y1) <= 0.4 * 332800 and (x2 - x1) * 1.0 / (y2 - y1) between 0.25 and 4.0 as icon from li_boxes"""),
)
def box_scalars(spark, sf_dir):
    b = G.Box.of()
    placed = G.letterbox(b, F.lit(1000), F.lit(520), 1280.0, 720.0)
    return view(spark, sf_dir, "li_boxes").select(
        "page_id", "idx", b.area.alias("area"), b.cx.alias("cx"), b.cy.alias("cy"), b.clamp(F.lit(640), F.lit(520)).width.alias("clamped"), G.scaled(9, b.y2).alias("scaled"), placed["x1"].alias("box_x"), G.outline_native(b).alias("native"), G.icon_like(b, F.lit(332800)).alias("icon")
    )


@register(
    "value_scalars",
    with_views("li_boxes", select="""select page_id, idx, floor((x2 - x1) / 2.0 + 0.5) as half, greatest(6, least(96, (y2 - y1) * 72 * 7.5 / 520 * cast(0.78 as double))) as points,
list_reduce([8, 9, 10, 11, 12, 14, 16, 18, 20, 24, 28, 32, 36, 40, 44, 48, 54, 60, 66, 72, 80, 88], lambda a, b: case when abs(b - (y2 - y1)) < abs(a - (y2 - y1)) then b else a end) as step,
sqrt(pow(x1 % 256 - x2 % 256, 2) + pow(y1 % 256 - y2 % 256, 2)) as distance, abs(x1 % 256 - x2 % 256) <= 40 and abs(y1 % 256 - y2 % 256) <= 40 as close, printf('#%02X%02X%02X', x1 % 256, y1 % 256, 0) as hex from li_boxes"""),
)
def value_scalars(spark, sf_dir):
    a = F.struct((F.col("x1") % 256).alias("r"), (F.col("y1") % 256).alias("g"), F.lit(0).alias("b"))
    b = F.struct((F.col("x2") % 256).alias("r"), (F.col("y2") % 256).alias("g"), F.lit(0).alias("b"))
    h = F.col("y2") - F.col("y1")
    rows = view(spark, sf_dir, "li_boxes").withColumns({"a": a, "b": b})
    a, b = F.col("a"), F.col("b")
    return rows.select("page_id", "idx", V.half_up((F.col("x2") - F.col("x1")) / 2.0).alias("half"), V.font_points(h, F.lit(520)).alias("points"), V.ladder_snap(h).alias("step"), V.colour_distance(a, b).alias("distance"), V.close_colours(a, b, 40).alias("close"), V.hex_colour(a["r"], a["g"], a["b"]).alias("hex"))


@register(
    "calibration_step",
    with_views("li_boxes", select="""select page_id, idx, case when abs(dx) <= 0.15 then 0.0 else greatest(-12, least(12, dx)) end as dx, case when abs(dy) <= 0.15 then 0.0 else greatest(-12, least(12, dy)) end as dy,
greatest(cast(0.82 as double), least(cast(1.12 as double), greatest(0.5, least(2.0, exp(0.5 * ln((x2 - x1) * 1.0 / (mx2 - mx1))))) * greatest(0.5, least(2.0, exp(0.5 * ln((y2 - y1) * 1.0 / (my2 - my1))))))) as ratio from
(select *, case when kind = 'image' then (x1 + x2 - mx1 - mx2) / 2.0 else x1 - mx1 end as dx, (y1 + y2 - my1 - my2) / 2.0 as dy from (select *, x1 + idx % 5 as mx1, x2 + idx % 7 as mx2, y1 - idx % 3 as my1, y2 as my2 from li_boxes) m) d"""),
)
def calibration_step(spark, sf_dir):
    """Boxes against the same boxes measured a little off."""
    boxes = view(spark, sf_dir, "li_boxes").withColumn("align", F.when(F.col("kind") == "image", "center").otherwise("left"))
    off = boxes.select("page_id", "idx", (F.col("x1") + F.col("idx") % 5).alias("x1"), (F.col("y1") - F.col("idx") % 3).alias("y1"), (F.col("x2") + F.col("idx") % 7).alias("x2"), "y2")
    return fitting.calibration_step(boxes, off, ["page_id", "idx"])


@register(
    "argmin_grid",
    with_views("li_boxes", select="select page_id, idx, best, cost from (select page_id, idx, size as best, abs(size * 6.0 - (x2 - x1)) as cost, row_number() over (partition by page_id, idx order by abs(size * 6.0 - (x2 - x1)), size) as rn from li_boxes cross join (select unnest(range(6, 31)) as size) s) x where rn = 1"),
)
def argmin_grid(spark, sf_dir):
    """The font size from 6 to 30 whose width of six units comes nearest the box."""
    return fitting.argmin_grid(view(spark, sf_dir, "li_boxes"), ["page_id", "idx"], 6, 30, F.abs(F.col("size") * 6.0 - (F.col("x2") - F.col("x1"))))


_UNIT = "case when regexp_matches(ch, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7A3}\\x{FF00}-\\x{FFEF}]') then 2.0 when regexp_matches(ch, '[\\x09-\\x0D ]') then 0.5 else 1.0 end"


@register(
    "char_boxes",
    with_views("lines", select=f""", c as (select doc_id as page_id, ln as idx, unnest(range(length(line))) as i, unnest(list_transform(range(1, length(line) + 1), lambda j: line[j])) as ch from lines),
u as (select *, sum(u) over (partition by page_id, idx order by i) as upto, sum(u) over (partition by page_id, idx) as total from (select *, {_UNIT} as u from c) x)
select page_id, idx, count(*) as n, round(avg(600 * (upto - u) / total), 3) as x1, round(avg(600 * upto / total), 3) as x2, round(max(600 * upto / total), 3) as last, round(min(600 * u / total), 3) as least from u group by page_id, idx""").replace(") , c", "), c"),
)
def char_boxes(spark, sf_dir):
    """Whole lines split over 600 pixels by character; the means of each line's boxes, its last edge and narrowest box."""
    rows = view(spark, sf_dir, "lines")
    boxes = fitting.char_boxes(rows.select(F.col("doc_id").alias("page_id"), F.col("ln").alias("idx"), F.col("line").alias("text"), F.lit(0).alias("x1"), F.lit(600).alias("x2")))
    means = [F.round(F.avg("x1"), 3).alias("x1"), F.round(F.avg("x2"), 3).alias("x2"), F.round(F.max("x2"), 3).alias("last"), F.round(F.min(F.col("x2") - F.col("x1")), 3).alias("least")]
    return boxes.groupBy("page_id", "idx").agg(F.count("*").alias("n"), *means)
