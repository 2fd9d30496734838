"""Queries over the passes that finish classed texts, and over jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.geometry import Box
from quire.operators import finishing, islands, quality, slots, spatial
from quire.plans.box_plans import _AREA, _CONTAINS, _IMG, _TXT
from quire.plans.catalogue import register
from quire.plans.views import view, with_views


def _boxes(spark, sf_dir):
    return view(spark, sf_dir, "li_boxes")


@register(
    "modal_cluster",
    with_views("li_boxes", select=""", s as (select page_id, x1, case when x1 - lag(x1) over (partition by page_id order by x1) > 90 then 1 else 0 end as new from li_boxes),
c as (select page_id, x1, sum(new) over (partition by page_id order by x1) as c from s), n as (select page_id, c, count(*) as n, quantile_cont(x1, 0.5) as m from c group by page_id, c),
o as (select *, max(n) over (partition by page_id) as most from n)
select page_id, round(arg_max(m, n * 100000 + m), 3) as target from o where n >= greatest(2, most - 1) group by page_id""").replace(") , s as", "), s as"),
)
def modal_cluster(spark, sf_dir):
    """The left edge that most boxes of a page share, within 90 pixels."""
    return finishing.modal_cluster(_boxes(spark, sf_dir), ["page_id"], "x1", gap=90)


@register("median_cluster")
def median_cluster(spark, sf_dir):
    """Boxes by left edge around a running median; held against a plain loop in tests."""
    return islands.median_cluster(_boxes(spark, sf_dir), ["page_id"], "x1", 60).select("page_id", "idx", "x1", "cluster")


def _scoped(spark, sf_dir):
    """Texts, and the pages of ten orders as scopes of one another."""
    boxes = _boxes(spark, sf_dir)
    box = Box.of()
    texts = boxes.select(F.floor(F.col("page_id") / 10).alias("page_id"), (F.col("page_id") % 10 * 100 + F.col("idx")).alias("idx"), (F.col("x1") % 60).alias("x1"), F.col("y1").alias("y1"), (F.col("x1") % 60 + 40).alias("x2"), (F.col("y1") + 16).alias("y2"), (F.col("kind") == "text").alias("label"), (F.col("page_id") % 3).alias("part"), box.area.alias("area"))
    both = texts.select("page_id", F.col("idx").alias("text_idx"), F.explode(F.array(F.lit(3), F.col("part"))).alias("container_idx"))
    return texts, both.withColumn("area", F.when(F.col("container_idx") == 3, 1000).otherwise(F.col("container_idx")))


@register("table_column_snap")
def table_column_snap(spark, sf_dir):
    """Labels of ten orders in columns, thirds of the orders first; held against a plain loop in tests."""
    texts, contains = _scoped(spark, sf_dir)
    return finishing.table_column_snap(texts, contains)


_LABEL = "substring('ABcdefgh ijklmn', 1, cast({0} % 15 + 1 as int))"


def _labels(spark, sf_dir):
    return _boxes(spark, sf_dir).withColumn("text", F.expr(_LABEL.format("x1")))


@register(
    "stack_center",
    with_views("li_boxes", select=f""", t as (select *, {_LABEL.format("x1")} as text from li_boxes), p as (select a.page_id, a.idx as a, b.idx as b, a.text as ta, b.text as tb, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2 from t a join t b on a.page_id = b.page_id and a.idx < b.idx),
q as (select *, cast(ax2 - ax1 as double) as aw, cast(bx2 - bx1 as double) as bw, cast(ay2 - ay1 as double) as ah, cast(by2 - by1 as double) as bh, abs(ay1 + ay2 - by1 - by2) / 2.0 as down, abs(ax1 + ax2 - bx1 - bx2) / 2.0 as across, length(replace(ta, ' ', '')) as va, length(replace(tb, ' ', '')) as vb from p),
r as (select *, va + least(8.0, greatest(0.0, aw / 40)) + least(4.0, greatest(0.0, ah / 8)) as ra, vb + least(8.0, greatest(0.0, bw / 40)) + least(4.0, greatest(0.0, bh / 8)) as rb from q
  where va between 1 and 14 and vb between 1 and 14 and down >= greatest(8.0, cast(0.42 as double) * least(ah, bh)) and down <= greatest(38.0, cast(1.85 as double) * (ah + bh) / 2) and greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) >= cast(0.55 as double) * least(aw, bw) and across > 1 and across <= greatest(24.0, cast(0.42 as double) * least(aw, bw)))
select page_id, a, b, cast(case when ra > rb or (ra = rb and va >= vb) then (ax1 + ax2) / 2.0 else (bx1 + bx2) / 2.0 end as double) as center from r""").replace(") , t as", "), t as"),
)
def stack_center(spark, sf_dir):
    """Stacks of two labels on a page; the pairs overlap, so they meet on grid cells."""
    rows = _labels(spark, sf_dir)
    # centres are apart by up to 1.85 mean heights of 172 pixels at most
    tall = rows.select("page_id", "idx", "x1", (F.col("y1") - 80).alias("y1"), "x2", (F.col("y2") + 80).alias("y2"))
    pairs = spatial.box_pairs(tall, tall).where("idx_a < idx_b").select("page_id", F.col("idx_a").alias("a"), F.col("idx_b").alias("b"))
    side = lambda s: rows.select("page_id", F.col("idx").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("text", "x1", "y1", "x2", "y2")])
    found = finishing.stack_center(pairs.join(side("a"), ["page_id", "a"]).join(side("b"), ["page_id", "b"]))
    return found.select("page_id", "a", "b", "center")


@register(
    "label_shapes",
    with_views("lines", select=r"""select doc_id, ln, s <> '' and n <= 16 and not regexp_matches(s, '[\x09-\x0D ]') and translate(s, '，。！？；;,:：、/\()（）[]{}<>《》', '') = s and length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 2 and length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= cast(0.55 as double) * greatest(n, 1) as compact,
  s <> '' and n <= 14 and translate(s, '，。！？；;,:：', '') = s as stack from (select doc_id, ln, w as s, length(w) as n from words_of) x""").replace("words_of", "(select doc_id, ln, unnest(string_split(line, ' ')) as w from lines) z"),
)
def label_shapes(spark, sf_dir):
    """Which words of all lines could be compact Latin labels, or labels of a stack."""
    words = view(spark, sf_dir, "lines").select("doc_id", "ln", F.explode(F.split("line", " ")).alias("w"))
    return words.select("doc_id", "ln", finishing.compact_latin_label(F.col("w")).alias("compact"), finishing.short_stack_text(F.col("w")).alias("stack"))


_CHANNELS = {"r": "x1 % 256", "g": "(x1 + y1 % 40) % 256", "b": "(x1 + x2 % 50) % 256"}


@register(
    "colour_snap",
    with_views("li_boxes", select=""", c as (select page_id, idx, x1 % 256 as r, (x1 + y1 % 40) % 256 as g, (x1 + x2 % 50) % 256 as b, cast(120 as int) as l from li_boxes)
select page_id, idx, (abs(r - l) <= 60 and abs(g - l) <= 60 and abs(b - l) <= 60) or (abs(r - g) < 20 and abs(g - b) < 20 and abs(r - b) < 20 and abs(cast(0.299 as double) * r + cast(0.587 as double) * g + cast(0.114 as double) * b - l) < 130) as same from c""").replace(") , c as", "), c as"),
)
def colour_snap(spark, sf_dir):
    """Which colours count as a middle grey."""
    rows = _boxes(spark, sf_dir).select("page_id", "idx", *[F.expr(e).alias(k) for k, e in _CHANNELS.items()])
    line = F.lit(120)
    return rows.select("page_id", "idx", finishing.colour_snap(F.col("r"), F.col("g"), F.col("b"), (line, line, line)).alias("same"))


@register("fuzzy_rle")
def fuzzy_rle(spark, sf_dir):
    """Whole lines as runs of like colour, capitals and digits coloured; held against a plain loop in tests."""
    char = lambda c: F.struct(c.alias("ch"), *[F.when(c == " ", None).when(c.between("A", "Z"), v).when(c.between("0", "9"), v + 30).otherwise(20).cast("int").alias(k) for k, v in (("r", 200), ("g", 60), ("b", 60))])
    chars = F.transform(F.filter(F.split("line", ""), lambda c: c != ""), char)
    lines = view(spark, sf_dir, "lines").select("doc_id", "ln", chars.alias("chars"), F.lit(20).alias("r"), F.lit(20).alias("g"), F.lit(20).alias("b"))
    return finishing.fuzzy_rle(lines, ["doc_id", "ln"])


_CELLS = "select l_orderkey as page_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as int) as row, cast(l_partkey % 6 as int) as col, case when l_suppkey % 2 = 0 then cast(cast(l_quantity as int) as string) else l_linestatus end as text, cast(count(*) over (partition by l_orderkey) as int) as rows from {0}"


@register(
    "style_cells",
    f"""with c as ({_CELLS.format("lineitem")}), k as (select *, row = 0 or (row = rows - 1 and col = 0) as dark, row = rows - 1 as total, col > 0 and regexp_matches(text, '[0-9]') as number from c)
select page_id, row, col, case when dark then '#08498D' when total then '#EEF4FB' when row % 2 = 1 then '#F7FAFE' else '#EEF3FA' end as fill,
  case when dark then '#FFFFFF' when total and col in (1, 2, 4) then '#C01818' when total then '#054798' when number and text in ('5', '3', '1') and col in (1, 4) then '#D43E3E' when number and text = '0' then '#777777' when number then '#054798' when col = 0 then '#666666' else '#222222' end as color,
  dark or total or number as bold, case when dark or total or col > 0 then 'center' else 'left' end as align, case when dark then 8 when total and number then 18 when total then 9 when number then 16 else 8 end as size from k""",
)
def style_cells(spark, sf_dir):
    """The lines of an order as rows of a table."""
    cells = spark.sql(_CELLS.format("{lineitem}"), lineitem=view(spark, sf_dir, "lineitem"))
    return finishing.style_cells(cells).select("page_id", "row", "col", "fill", "color", "bold", "align", "size")


@register(
    "ruled_prefilter",
    with_views("li_boxes", select="""select page_id, across, down, across >= least(2, greatest(1, n - 1)) and down >= 1 as ok from (select page_id, count(*) filter (x2 - x1 > y2 - y1 and x2 - x1 >= cast(0.45 as double) * 400) as across, count(*) filter (x2 - x1 <= y2 - y1 and y2 - y1 >= cast(0.35 as double) * 300) as down, max(idx) + 1 as n from li_boxes group by page_id) x"""),
)
def ruled_prefilter(spark, sf_dir):
    """Boxes as rules of a table of 400 by 300 pixels with as many rows as boxes and two columns."""
    rows = _boxes(spark, sf_dir).withColumn("horizontal", F.col("x2") - F.col("x1") > F.col("y2") - F.col("y1"))
    return finishing.ruled_prefilter(rows, ["page_id"], F.lit(400), F.lit(300), F.col("idx") + 1, F.lit(2))


@register("ruled_candidates")
def ruled_candidates(spark, sf_dir):
    """Grids among the boxes of ten orders taken as rules; held against planted grids in tests."""
    b = _boxes(spark, sf_dir)
    flat = b.select(F.floor(F.col("page_id") / 10).alias("page_id"), (F.col("page_id") % 10 * 100 + F.col("idx")).alias("idx"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], (F.col("kind") == "text").alias("horizontal"))
    level = F.when(F.col("horizontal"), F.col("y1") + 2).otherwise(F.col("y2") + 200)
    return finishing.ruled_candidates(flat.withColumn("y2", level))


@register(
    "split_rows",
    with_views("lines", select=""", s as (select doc_id, ln, length(trim(line)) > 40 as ok, max(ln) over (partition by doc_id) + 1 as whole from lines), n as (select *, case when ln - lag(ln) over (partition by doc_id order by ln) > 2 then 1 else 0 end as new from s where ok),
r as (select *, sum(new) over (partition by doc_id order by ln) as run from n), g as (select doc_id, min(ln) as start, case when max(whole) - max(ln) - 1 < 1 then max(whole) else max(ln) + 1 end as stop from r group by doc_id, run)
select doc_id, start, stop from (select *, count(*) over (partition by doc_id) as m from g where stop - start >= 2) x where m >= 2""").replace(") , s as", "), s as"),
)
def split_rows(spark, sf_dir):
    """Stretches of long lines, which one short line doesn't end."""
    signal = view(spark, sf_dir, "lines").select("doc_id", "ln", (F.length(F.trim("line")) > 40).alias("ok"))
    return finishing.split_rows(signal, ["doc_id"], "ln", "ok", gap=1, least=2)


@register(
    "split_axis",
    with_views("lines", select=""", s as (select doc_id, ln, length(trim(line)) > 40 as ok from lines), r as (select *, ln - row_number() over (partition by doc_id, ok order by ln) as run, max(case when ok then 1 else 0 end) over (partition by doc_id order by ln rows between 1 following and unbounded following) as later from s),
g as (select doc_id, min(ln) as a, max(ln) + 1 as b from r where not ok group by doc_id, run having min(coalesce(later, 0)) = 1),
p as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as start, a as stop from g union all select g.doc_id, max(b), max(n) from g join (select doc_id, count(*) as n from lines group by doc_id) c using (doc_id) group by g.doc_id)
select * from p where stop > start""").replace(") , s as", "), s as"),
)
def split_axis(spark, sf_dir):
    """Blocks of long lines between stretches of short ones."""
    lines = view(spark, sf_dir, "lines")
    signal = lines.select("doc_id", "ln", (F.length(F.trim("line")) > 40).alias("ok"))
    size = lines.groupBy("doc_id").agg(F.count("*").alias("size"))
    return finishing.split_axis(islands.gap_runs(signal, ["doc_id"], "ln", "ok"), size, ["doc_id"])


@register(
    "cause_guess",
    """with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int) as e, cast(l_partkey % 50 as int) as f, cast(l_suppkey % 40 as int) as c, cast(l_discount * 100 as int) * 5 as s, cast(l_tax * 100 as int) as t from lineitem),
r as (select *, list_filter([case when abs(e - f) > 4 then case when f < e then 'lost' else 'added' end end, case when c > 25 then 'colour ' || c end, case when abs(s - t) > 25 and t < s then 'filled' end], lambda x: x is not null) as rs from d)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when len(rs) > 0 then rs when abs(e - f) > 1.5 then ['shifted'] else ['rendering'] end as reasons from r""",
)
def cause_guess(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = view(spark, sf_dir, "lineitem").select(*key, F.expr("cast(l_quantity as int)").alias("e"), F.expr("l_partkey % 50").alias("f"), F.expr("l_suppkey % 40").alias("c"), F.expr("cast(l_discount * 100 as int) * 5").alias("s"), F.expr("cast(l_tax * 100 as int)").alias("t"))
    return rows.select(*key, quality.cause_guess(F.col("e"), F.col("f"), F.col("c").cast("double"), F.col("s"), F.col("t")).alias("reasons"))


@register("active_history", with_views("jobs", select="select owner_id, count(*) filter (status in ('queued', 'running')) as active, count(*) filter (status not in ('queued', 'running')) as history from jobs group by owner_id"))
def active_history(spark, sf_dir):
    return finishing.active_history(view(spark, sf_dir, "jobs"), ["owner_id"])


@register(
    "sibling_slot",
    with_views("li_boxes", select=f""", c as (select b.page_id, b.idx as t, a.idx as c, {_AREA.replace("x", "a.x").replace("y", "a.y")} as area from {_IMG} a join {_TXT} b on a.page_id = b.page_id and {_CONTAINS}),
s as (select a.page_id, a.idx as a, b.idx as b from {_IMG} a join {_IMG} b on a.page_id = b.page_id and a.idx < b.idx),
m as (select c.page_id, c.t, c.c, (t.x1 - o.x1) / greatest(1.0, o.x2 - o.x1) as l, (t.y1 - o.y1) / greatest(1.0, o.y2 - o.y1) as u, (t.x2 - t.x1) / greatest(1.0, o.x2 - o.x1) as w, (t.y2 - t.y1) / greatest(1.0, o.y2 - o.y1) as h from c join li_boxes t on t.page_id = c.page_id and t.idx = c.t join li_boxes o on o.page_id = c.page_id and o.idx = c.c)
select distinct p.page_id, least(p.t, q.t) as a, greatest(p.t, q.t) as b from s join m p on p.page_id = s.page_id and p.c = s.a join m q on q.page_id = s.page_id and q.c = s.b
where p.t <> q.t and abs(p.l - q.l) <= cast(0.08 as double) and abs(p.u - q.u) <= cast(0.10 as double) and abs(p.w - q.w) <= cast(0.22 as double) and abs(p.h - q.h) <= cast(0.16 as double)""").replace(") , c as", "), c as"),
)
def sibling_slot(spark, sf_dir):
    """Texts at like places of the images of a page, any two images being siblings."""
    boxes = _boxes(spark, sf_dir)
    texts, images = boxes.where("kind = 'text'"), boxes.where("kind = 'image'")
    pairs = images.select("page_id", F.col("idx").alias("a")).join(images.select("page_id", F.col("idx").alias("b")), "page_id").where("a < b")
    return finishing.sibling_slot(texts, spatial.containment_join(texts, images), images, pairs)


@register("merge_finalizers")
def merge_finalizers(spark, sf_dir):
    """Texts of an order by quantity class, centred, sized and aligned in turn; held against a plain loop in tests."""
    texts = _boxes(spark, sf_dir).where("kind = 'text'").withColumns({"size": F.col("y2") - F.col("y1"), "bold": F.col("idx") % 2 == 0, "align": F.element_at(F.array(F.lit("left"), F.lit("right")), (F.col("x1") % 2 + 1).cast("int"))})
    classes = texts.select("page_id", "idx", (F.col("x1") % 2).cast("int").alias("class_idx"))
    return finishing.merge_finalizers(texts, classes).select("page_id", "idx", "x1", "x2", "size", "align")


@register("clear_annotations", with_views("li_boxes", select="select page_id, idx, kind from li_boxes where idx % 4 <> 3"))
def clear_annotations(spark, sf_dir):
    """Elements with what a pass added, taken away twice."""
    rows = _boxes(spark, sf_dir).select("page_id", "idx", "kind", (F.col("idx") % 4 == 3).alias("inferred"), F.lit(1).alias("new_size"))
    return finishing.clear_annotations(finishing.clear_annotations(rows))


@register("role_lists", with_views("li_boxes", select="select page_id, coalesce(list(concat(kind, '_', cast(idx as varchar)) order by idx) filter (kind = 'text'), []) as text, coalesce(list(concat(kind, '_', cast(idx as varchar)) order by idx) filter (kind = 'image'), []) as image, [] as shape from li_boxes group by page_id"))
def role_lists(spark, sf_dir):
    return finishing.role_lists(_boxes(spark, sf_dir))
