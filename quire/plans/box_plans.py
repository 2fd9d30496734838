"""Queries over boxes: spatial joins, orders, gaps and islands."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.geometry import Box
from quire.operators import islands, spatial
from quire.plans.catalogue import register
from quire.plans.views import view, with_views

_AREA = "(x2 - x1) * (y2 - y1)"
_INT = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_A, _B = "((a.x2 - a.x1) * (a.y2 - a.y1))", "((b.x2 - b.x1) * (b.y2 - b.y1))"
_SELF = "from li_boxes a join li_boxes b on a.page_id = b.page_id and a.idx <> b.idx"
_TXT = "(select * from li_boxes where kind = 'text')"
_IMG = "(select * from li_boxes where kind = 'image')"
_CONTAINS = f"(b.x1 + b.x2) / 2.0 between a.x1 - 6 and a.x2 + 6 and (b.y1 + b.y2) / 2.0 between a.y1 - 6 and a.y2 + 6 and {_INT} >= cast(0.55 as double) * {_B}"


def _boxes(spark, sf_dir):
    return view(spark, sf_dir, "li_boxes")


def _texts(spark, sf_dir):
    return _boxes(spark, sf_dir).where("kind = 'text'")


def _images(spark, sf_dir):
    return _boxes(spark, sf_dir).where("kind = 'image'")


@register("containment_join", with_views("li_boxes", select=f"select b.page_id, b.idx as text_idx, a.idx as container_idx, {_A} as area from {_IMG} a join {_TXT} b on a.page_id = b.page_id and {_CONTAINS}"))
def containment_join(spark, sf_dir):
    """Texts in images."""
    return spatial.containment_join(_texts(spark, sf_dir), _images(spark, sf_dir))


@register("ancestors", with_views("li_boxes", select=f"select b.page_id, b.idx as text_idx, list(a.idx order by {_A}, a.idx) as containers from {_IMG} a join {_TXT} b on a.page_id = b.page_id and {_CONTAINS} group by b.page_id, b.idx"))
def ancestors(spark, sf_dir):
    return spatial.ancestors(containment_join(spark, sf_dir))


@register(
    "common_scope",
    with_views("li_boxes", select=f""", c as (select b.page_id, b.idx as t, a.idx as c, {_A} as area from {_IMG} a join {_TXT} b on a.page_id = b.page_id and {_CONTAINS}),
r as (select * from c where (page_id, c) in (select page_id, c from c group by page_id, c having count(*) >= 2))
select p.page_id, p.t as a, q.t as b, arg_min(p.c, p.area * 1000 + p.c) as container_idx from r p join r q on p.page_id = q.page_id and p.c = q.c and p.t < q.t group by p.page_id, p.t, q.t""").replace(") , c as", "), c as"),
)
def common_scope(spark, sf_dir):
    return spatial.common_scope(containment_join(spark, sf_dir), 2)


@register(
    "smallest_container",
    with_views("li_boxes", select=f"""select page_id, text_idx, container_idx, area from (select b.page_id, b.idx as text_idx, a.idx as container_idx, {_A} as area, row_number() over (partition by b.page_id, b.idx order by {_A}, a.idx) as rn
from {_IMG} a join {_TXT} b on a.page_id = b.page_id and b.x1 >= a.x1 and b.y1 >= a.y1 and b.x2 <= a.x2 and b.y2 <= a.y2) x where rn = 1"""),
)
def smallest_container(spark, sf_dir):
    return spatial.smallest_container(_texts(spark, sf_dir), _images(spark, sf_dir))


@register(
    "centre_in_container",
    with_views("li_boxes", select=f""", h as (select page_id, idx, container_idx, cx1, cx2 from (select b.page_id, b.idx, a.idx as container_idx, a.x1 as cx1, a.x2 as cx2, row_number() over (partition by b.page_id, b.idx order by {_A}, a.idx) as rn
from {_IMG} a join {_TXT} b on a.page_id = b.page_id and b.x1 >= a.x1 and b.y1 >= a.y1 and b.x2 <= a.x2 and b.y2 <= a.y2) x where rn = 1),
m as (select t.page_id, t.idx, h.container_idx, t.x1, t.x2, (cx1 + cx2) / 2.0 as mid, coalesce(abs((t.x1 + t.x2) / 2.0 - (cx1 + cx2) / 2.0) <= least(0.05 * (cx2 - cx1), 25.0), false) as mv from {_TXT} t left join h on t.page_id = h.page_id and t.idx = h.idx)
select page_id, idx, container_idx, case when mv then mid - (x2 - x1) / 2.0 else x1 end as new_x1, case when mv then mid + (x2 - x1) / 2.0 else x2 end as new_x2, case when mv then 'center' end as align from m""").replace(") , h as", "), h as"),
)
def centre_in_container(spark, sf_dir):
    texts = _texts(spark, sf_dir).withColumn("text", F.lit("label"))
    return spatial.centre_in_container(texts, _images(spark, sf_dir)).select("page_id", "idx", "container_idx", "new_x1", "new_x2", "align")


@register(
    "point_in_rect",
    with_views("li_boxes", select=f"""select b.page_id, a.idx as cell_idx, string_agg('t' || b.idx, ' ' order by b.y1, b.x1, b.idx) as text, count(*) as items
from {_IMG} a join {_TXT} b on a.page_id = b.page_id and (b.x1 + b.x2) // 2 between a.x1 and a.x2 and (b.y1 + b.y2) // 2 between a.y1 and a.y2 group by b.page_id, a.idx"""),
)
def point_in_rect(spark, sf_dir):
    items = _texts(spark, sf_dir).withColumn("text", F.concat(F.lit("t"), F.col("idx")))
    return spatial.point_in_rect(items, _images(spark, sf_dir))


@register("consume_anti", with_views("li_boxes", select=f"select page_id, idx from {_TXT} b where not exists (select 1 from {_IMG} a where a.page_id = b.page_id and (b.x1 + b.x2) / 2.0 between a.x1 and a.x2 and (b.y1 + b.y2) / 2.0 between a.y1 and a.y2)"))
def consume_anti(spark, sf_dir):
    return spatial.consume_anti(_texts(spark, sf_dir), _images(spark, sf_dir)).select("page_id", "idx")


@register("overlap_exists", with_views("li_boxes", select=f"select page_id, idx from {_IMG} b where exists (select 1 from {_TXT} a where a.page_id = b.page_id and {_INT} > 0)"))
def overlap_exists(spark, sf_dir):
    return spatial.overlap_exists(_images(spark, sf_dir), _texts(spark, sf_dir)).select("page_id", "idx")


@register("covered_anti", with_views("li_boxes", select=f"select page_id, idx from li_boxes b where not exists (select 1 from li_boxes a where a.page_id = b.page_id and a.idx <> b.idx and {_INT} >= 0.8 * {_B})"))
def covered_anti(spark, sf_dir):
    return spatial.covered_anti(_boxes(spark, sf_dir), _boxes(spark, sf_dir)).select("page_id", "idx")


@register("duplicate_outlines", with_views("li_boxes", select=f"select page_id, idx from li_boxes b where not exists (select 1 from li_boxes a where a.page_id = b.page_id and a.idx < b.idx and least({_A}, {_B}) >= 0.6 * greatest({_A}, {_B}) and {_INT} >= 0.5 * least({_A}, {_B}))"))
def duplicate_outlines(spark, sf_dir):
    return spatial.duplicate_outlines(_boxes(spark, sf_dir), 0.6, 0.5).select("page_id", "idx")


_PAGE = 640 * 520
_SHORT = "least(a.x2 - a.x1, a.y2 - a.y1)"
_BAND = f"least(greatest(round_even(0.22 * {_SHORT}, 0), 4), 14)"
_NEARX = f"((b.x1 + b.x2) / 2.0 - a.x1 <= {_BAND} or a.x2 - (b.x1 + b.x2) / 2.0 <= {_BAND})"
_NEARY = f"((b.y1 + b.y2) / 2.0 - a.y1 <= {_BAND} or a.y2 - (b.y1 + b.y2) / 2.0 <= {_BAND})"
_LONG = "greatest(b.x2 - b.x1, b.y2 - b.y1) >= 12 and greatest(b.x2 - b.x1, b.y2 - b.y1) >= 2 * least(b.x2 - b.x1, b.y2 - b.y1)"
_BORDER = f"({_INT} >= 0.8 * {_B} and ({_NEARX} or {_NEARY}) and (({_LONG}) or ({_NEARX} and {_NEARY})))"


@register("carried_by_parent", with_views("li_boxes", select=f"select page_id, idx from li_boxes b where exists (select 1 from li_boxes a where a.page_id = b.page_id and a.idx <> b.idx and (({_INT} >= 0.92 * {_B} and {_A} >= 2.8 * {_B} and {_A} <= 0.85 * {_PAGE}) or {_BORDER}))"))
def carried_by_parent(spark, sf_dir):
    return spatial.carried_by_parent(_boxes(spark, sf_dir), _boxes(spark, sf_dir), F.lit(_PAGE)).select("page_id", "idx")


@register("children_of_parent", with_views("li_boxes", select=f"select a.page_id, a.idx as parent_idx, b.idx as child_idx {_SELF} and {_INT} >= 0.85 * {_B} and {_B} < 0.55 * {_A} and (least(b.x2 - b.x1, b.y2 - b.y1) <= 24 or greatest(b.x2 - b.x1, b.y2 - b.y1) <= 96)"))
def children_of_parent(spark, sf_dir):
    return spatial.children_of_parent(_boxes(spark, sf_dir))


@register("nested_child_pairs", with_views("li_boxes", select=f"select a.page_id, a.idx as parent_idx, b.idx as child_idx, {_B} as child_area {_SELF} and {_A} > 2 * {_B} and {_INT} >= 0.85 * {_B}"))
def nested_child_pairs(spark, sf_dir):
    return spatial.nested_child_pairs(_boxes(spark, sf_dir))


@register(
    "redundant_wrapper",
    with_views("li_boxes", select=f""", i as (select a.page_id, a.idx as o, b.idx, b.x1, b.y1, b.x2, b.y2 {_SELF} and {_INT} >= 0.4 * {_B} and {_B} < 0.95 * {_A})
select distinct p.page_id, p.o as idx from i p join i q on p.page_id = q.page_id and p.o = q.o and p.idx < q.idx
where greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0) >= 0.5 * least(p.y2 - p.y1, q.y2 - q.y1) and greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) <= 0.5 * least(p.x2 - p.x1, q.x2 - q.x1)""").replace(") , i as", "), i as"),
)
def redundant_wrapper(spark, sf_dir):
    return spatial.redundant_wrapper(_boxes(spark, sf_dir), 0.4, 0.95, 0.5, 0.5).select("page_id", "idx")


@register("top_badge", with_views("li_boxes", select=f"select page_id, idx from li_boxes b where exists (select 1 from li_boxes a where a.page_id = b.page_id and a.idx <> b.idx and b.y1 < a.y1 and b.y2 > a.y1 and (b.x1 + b.x2) / 2.0 between a.x1 and a.x2 and greatest(b.x2 - b.x1, b.y2 - b.y1) <= 120 and {_B} < 0.25 * {_A})"))
def top_badge(spark, sf_dir):
    return spatial.top_badge(_boxes(spark, sf_dir), _boxes(spark, sf_dir), 120).select("page_id", "idx")


@register("neighbour_semi", with_views("li_boxes", select="select page_id, idx from li_boxes b where exists (select 1 from li_boxes a where a.page_id = b.page_id and a.idx <> b.idx and greatest(a.x1, b.x1) - least(a.x2, b.x2) <= 30 and greatest(a.y1, b.y1) - least(a.y2, b.y2) <= 10)"))
def neighbour_semi(spark, sf_dir):
    return spatial.neighbours(_boxes(spark, sf_dir), 30, 10).select("page_id", "idx")


@register(
    "sibling_containers",
    with_views("li_boxes", select="""select a.page_id, a.idx as a, b.idx as b from li_boxes a join li_boxes b on a.page_id = b.page_id and a.idx < b.idx
where greatest(a.x2 - a.x1, b.x2 - b.x1) <= 1.18 * least(a.x2 - a.x1, b.x2 - b.x1) and greatest(a.y2 - a.y1, b.y2 - b.y1) <= 1.22 * least(a.y2 - a.y1, b.y2 - b.y1)
  and (abs((a.y1 + a.y2) / 2.0 - (b.y1 + b.y2) / 2.0) <= greatest(12.0, 0.18 * least(a.y2 - a.y1, b.y2 - b.y1)) or abs((a.x1 + a.x2) / 2.0 - (b.x1 + b.x2) / 2.0) <= greatest(12.0, 0.18 * least(a.x2 - a.x1, b.x2 - b.x1)))"""),
)
def sibling_containers(spark, sf_dir):
    return spatial.sibling_containers(_boxes(spark, sf_dir))


@register("zorder", with_views("li_boxes", select=f"select page_id, idx, row_number() over (partition by page_id order by {_AREA} desc, y1, x1, idx) as z from li_boxes"))
def zorder(spark, sf_dir):
    return spatial.zorder(_boxes(spark, sf_dir)).select("page_id", "idx", "z")


@register("reading_order", with_views("li_boxes", select="select page_id, idx, row_number() over (partition by page_id order by y1, x1, idx) as position from li_boxes"))
def reading_order(spark, sf_dir):
    return spatial.reading_order(_boxes(spark, sf_dir)).select("page_id", "idx", "position")


@register("inventory_order", with_views("li_boxes", select="select page_id, idx, row_number() over (partition by page_id order by case when kind = 'text' then 1 else 0 end, case when idx % 3 = 0 then 0 when idx % 3 = 1 then 2 else 1 end, y1, x1, idx) as position from li_boxes"))
def inventory_order(spark, sf_dir):
    roles = F.expr("case when idx % 3 = 0 then 'background' when idx % 3 = 1 then 'outline' else 'other' end")
    return spatial.inventory_order(_boxes(spark, sf_dir).withColumn("role", roles), {"background": 0, "outline": 2}).select("page_id", "idx", "position")


@register("gap_cluster", with_views("li_boxes", select="select page_id, idx, cast(sum(n) over (partition by page_id order by y1, idx) as bigint) as cluster from (select page_id, idx, y1, case when y1 - lag(y1) over (partition by page_id order by y1, idx) > 30 then 1 else 0 end as n from li_boxes) x"))
def gap_cluster(spark, sf_dir):
    return islands.gap_cluster(_boxes(spark, sf_dir), ["page_id"], "y1", 30, ["idx"]).select("page_id", "idx", "cluster")


_CLUSTERS = "c as (select page_id, x1, cast(sum(n) over (partition by page_id order by x1 rows unbounded preceding) as bigint) as cluster from (select page_id, x1, case when x1 - lag(x1) over (partition by page_id order by x1) > 20 then 1 else 0 end as n from li_boxes) x)"


@register("column_centres", with_views("li_boxes", select=f", {_CLUSTERS} select page_id, cluster, cast(round_even(avg(x1), 0) as bigint) as centre, count(*) as n from c group by page_id, cluster").replace(") , c as", "), c as"))
def column_centres(spark, sf_dir):
    return islands.column_centres(_boxes(spark, sf_dir), ["page_id"], "x1", 20)


@register(
    "nearest_snap",
    with_views("li_boxes", select=f""", {_CLUSTERS}, m as (select page_id, cluster as j, cast(round_even(avg(x1), 0) as bigint) as x from c group by page_id, cluster)
select page_id, idx, j, distance from (select b.page_id, b.idx, m.j, abs(b.x1 - m.x) as distance, row_number() over (partition by b.page_id, b.idx order by abs(b.x1 - m.x), m.j) as rn from li_boxes b join m on b.page_id = m.page_id and abs(b.x1 - m.x) <= 20) x where rn = 1""").replace(") , c as", "), c as"),
)
def nearest_snap(spark, sf_dir):
    """Each box's left edge to the nearest column centre of its page."""
    centres = column_centres(spark, sf_dir).select("page_id", F.col("cluster").alias("j"), F.col("centre").alias("x"))
    return spatial.nearest_snap(_boxes(spark, sf_dir).select("page_id", "idx", F.col("x1").alias("x")), centres, 20)


@register(
    "interval_merge",
    with_views("li_boxes", select="""select page_id, x1, x2, n from (select page_id, r, min(x1) as x1, max(x2) as x2, count(*) as n from (select *, sum(g) over (partition by page_id order by x1, x2 rows unbounded preceding) as r from
(select *, case when x1 > max(x2) over (partition by page_id order by x1, x2 rows between unbounded preceding and 1 preceding) + 10 then 1 else 0 end as g from li_boxes) x) y group by page_id, r) z where x2 - x1 >= 40"""),
)
def interval_merge(spark, sf_dir):
    return islands.interval_merge(_boxes(spark, sf_dir), ["page_id"], gap=10, least=40)


@register("dedupe_overlap_row", with_views("li_boxes", select="select page_id, idx, x1 from (select *, max(x2) over (partition by page_id order by x1, idx rows between unbounded preceding and 1 preceding) as reach from li_boxes) x where coalesce(reach, -10000) <= x1 + 4"))
def dedupe_overlap_row(spark, sf_dir):
    return islands.dedupe_overlap_row(_boxes(spark, sf_dir), ["page_id"]).select("page_id", "idx", "x1")


@register(
    "xy_cut",
    with_views("li_boxes", select=""", s as (select *, sum(g) over (partition by page_id order by x1, x2, idx) as strip from (select *, case when x1 - max(x2) over (partition by page_id order by x1, x2, idx rows between unbounded preceding and 1 preceding) >= 8 then 1 else 0 end as g from li_boxes) x),
b as (select *, sum(h) over (partition by page_id, strip order by y1, y2, idx) as block from (select *, case when y1 - max(y2) over (partition by page_id, strip order by y1, y2, idx rows between unbounded preceding and 1 preceding) >= 6 then 1 else 0 end as h from s) x)
select page_id, cast(strip as bigint) as strip, cast(block as bigint) as block, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) as n from b group by page_id, strip, block""").replace(") , s as", "), s as"),
)
def xy_cut(spark, sf_dir):
    return islands.xy_cut(_boxes(spark, sf_dir), 8, 6)


@register(
    "gap_runs",
    with_views("lines", select=""", s as (select doc_id, ln, length(trim(line)) > 40 as ok from lines), r as (select *, ln - row_number() over (partition by doc_id, ok order by ln) as run, max(case when ok then 1 else 0 end) over (partition by doc_id order by ln rows between 1 following and unbounded following) as later from s)
select doc_id, min(ln) as start, max(ln) + 1 as stop from r where not ok group by doc_id, run having min(coalesce(later, 0)) = 1 and count(*) >= 1""").replace(") , s as", "), s as"),
)
def gap_runs(spark, sf_dir):
    """Stretches of short lines between long ones."""
    signal = view(spark, sf_dir, "lines").select("doc_id", "ln", (F.length(F.trim("line")) > 40).alias("ok"))
    return islands.gap_runs(signal, ["doc_id"], "ln", "ok")


@register(
    "rle_runs",
    with_views("li_boxes", select="""select page_id, run, kind, string_agg(cast(idx as varchar), '' order by idx) as text, count(*) as n from (select *, cast(sum(g) over (partition by page_id order by idx) as bigint) as run from
(select *, case when kind is distinct from lag(kind) over (partition by page_id order by idx) and row_number() over (partition by page_id order by idx) > 1 then 1 else 0 end as g from li_boxes) x) y group by page_id, run, kind"""),
)
def rle_runs(spark, sf_dir):
    """Boxes of one kind in a row."""
    return islands.rle_runs(_boxes(spark, sf_dir).withColumn("text", F.col("idx").cast("string")), ["page_id"], "idx", ["kind"])


@register(
    "nearest_fill",
    with_views("li_boxes", select=""", p as (select page_id, idx, x2 - x1 as v, kind = 'image' as miss from li_boxes), q as (select *, last_value(case when not miss then idx end ignore nulls) over w1 as bp, first_value(case when not miss then idx end ignore nulls) over w2 as ap,
last_value(case when not miss then v end ignore nulls) over w1 as bv, first_value(case when not miss then v end ignore nulls) over w2 as av from p window w1 as (partition by page_id order by idx rows between unbounded preceding and 1 preceding), w2 as (partition by page_id order by idx rows between 1 following and unbounded following))
select page_id, idx, case when not miss then v when bp is null then coalesce(av, v) when ap is null or idx - bp < ap - idx then bv when ap - idx < idx - bp then av else greatest(av, bv) end as filled from q""").replace(") , p as", "), p as"),
)
def nearest_fill(spark, sf_dir):
    """Images take the width of the nearest text in order."""
    rows = _boxes(spark, sf_dir).withColumn("w", F.col("x2") - F.col("x1"))
    return islands.nearest_fill(rows, ["page_id"], "idx", "w", F.col("kind") == "image").select("page_id", "idx", "filled")


@register(
    "axis_vote",
    with_views("li_boxes", select=""", g as (select page_id, kind, count(*) as n, max(x1) - min(x1) as sl, max((x1 + x2) / 2.0) - min((x1 + x2) / 2.0) as sc, max(x2) - min(x2) as sr, quantile_cont(x1, 0.5) as ml, quantile_cont((x1 + x2) / 2.0, 0.5) as mc, quantile_cont(x2, 0.5) as mr from li_boxes group by page_id, kind)
select page_id, kind, n, case when sl <= sc and sl <= sr then 'left' when sc <= sr then 'center' else 'right' end as axis, least(sl, sc, sr) as spread,
case when least(sl, sc, sr) <= 100 then case when sl <= sc and sl <= sr then ml when sc <= sr then mc else mr end end as target from g""").replace(") , g as", "), g as"),
)
def axis_vote(spark, sf_dir):
    return islands.axis_vote(_boxes(spark, sf_dir), ["page_id", "kind"], 100)


@register(
    "modal_median",
    """with b as (select l_suppkey as k, l_quantity as v from lineitem), m as (select k, arg_max(bin, n * 1000 - bin) as bin from (select k, floor(v / 16) as bin, count(*) as n from b group by all) x group by k),
r as (select b.k, v, abs(v - (bin + 0.5) * 16) <= 10 as near from b join m using (k))
select k, case when count(*) filter (near) >= 3 then quantile_cont(v, 0.5) filter (near) else quantile_cont(v, 0.5) end as centre, count(*) filter (near) as n from r group by k""",
)
def modal_median(spark, sf_dir):
    """Robust centre of the quantities of each supplier."""
    rows = view(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("double").alias("v"))
    return islands.modal_median(rows, ["k"], "v", 16, 10, 3)


@register("mode_in_group", with_views("li_boxes", select=""", c as (select page_id, h, arg_max(h, n * 1000 + h) over (partition by page_id) as d from (select page_id, y2 - y1 as h, count(*) as n from li_boxes group by all) x)
select b.page_id, b.idx, d as dominant from li_boxes b join (select distinct page_id, d from c) y using (page_id)""").replace(") , c as", "), c as"))
def mode_in_group(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumn("h", F.col("y2") - F.col("y1"))
    return islands.mode_in_group(rows, ["page_id"], "h").select("page_id", "idx", "dominant")


@register("coeff_var", with_views("li_boxes", select="select page_id, case when avg(y1) > 0 then stddev_pop(y1) / avg(y1) else cast('inf' as double) end as cv, count(*) as n from li_boxes group by page_id"))
def coeff_var(spark, sf_dir):
    return islands.coeff_var(_boxes(spark, sf_dir), ["page_id"], "y1")


@register("row_cluster")
def row_cluster(spark, sf_dir):
    """Rows of each page by the running mean of their centres; a fold, held against a plain loop in tests."""
    rows = _boxes(spark, sf_dir).withColumn("cy", Box.of().cy)
    return islands.row_cluster(rows, ["page_id"], "cy", 24)


@register("avg2_cluster")
def avg2_cluster(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumn("cy", Box.of().cy)
    return islands.avg2_cluster(rows, ["page_id"], "cy", 24)
