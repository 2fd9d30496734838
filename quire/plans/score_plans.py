"""Queries over scores, conversations, embeddings, jobs, logs and classes of boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.geometry import Box
from quire.operators import greedy, graph, islands, jobs, quality, slots, spatial
from quire.plans.catalogue import register
from quire.plans.views import view, with_views
from quire.session import stored

_NOW, _PREV = "(select * from scores where year = 1996)", "(select * from scores where year = 1995)"
_COMPARE = f"""t as (select n.fixture, n.composite as now, p.composite as prev, p.fixture is not null as old, n.n % 7 <> 0 as ok,
  n.composite - p.composite as d1, n.blurred - p.blurred as d2, n.histogram - p.histogram as d3, n.recall - p.recall as d4 from {_NOW} n left join {_PREV} p on n.fixture = p.fixture),
c as (select fixture, ok, old, now, prev, list_filter(['composite', 'blurred', 'histogram', 'recall'], lambda m, i: [d1, d2, d3, d4][i] < -[0.01, 0.02, 0.03, 0.01][i]) as down,
  list_filter(['composite', 'blurred', 'histogram', 'recall'], lambda m, i: [d1, d2, d3, d4][i] > [0.01, 0.02, 0.03, 0.01][i]) as up from t),
s as (select fixture, case when not ok then 'FAILED' when not old then 'NEW' when len(down) > 0 then 'REGRESSED' when len(up) > 0 then 'IMPROVED' else 'UNCHANGED' end as status, now as composite_now, case when ok then prev end as composite_prev,
  case when ok and old then down else [] end as regressions, case when ok and old then up else [] end as improvements from c)"""


def _scores(spark, sf_dir):
    s = view(spark, sf_dir, "scores").withColumn("ok", F.col("n") % 7 != 0)
    return s.where("year = 1996"), s.where("year = 1995")


@register("baseline_compare", with_views("scores", select=f", {_COMPARE} select * from s").replace(") , t as", "), t as"))
def baseline_compare(spark, sf_dir):
    """Supplier scores of one year against the year before."""
    return quality.baseline_compare(*_scores(spark, sf_dir))


@register(
    "suite_summary",
    with_views("scores", select=f""", {_COMPARE} select count(*) as fixtures, avg(composite_now) as avg_now, avg(composite_prev) as avg_prev, count(*) filter (status = 'FAILED') as failed, count(*) filter (status = 'REGRESSED') as regressed,
count(*) filter (status = 'IMPROVED') as improved, avg(composite_now) - avg(composite_prev) as delta, case when count(*) filter (status in ('FAILED', 'REGRESSED')) > 0 then 1 else 0 end as exit_status from s""").replace(") , t as", "), t as"),
)
def suite_summary(spark, sf_dir):
    return quality.suite_summary(quality.baseline_compare(*_scores(spark, sf_dir)))


_LONG = "(unpivot (select fixture, composite, blurred, histogram, recall from scores where year = {0}) on composite, blurred, histogram, recall into name metric value v)"


@register("deltas_long", with_views("scores", select=f"select n.fixture, n.metric, p.v as prev, n.v as now, round(n.v - p.v, 4) as delta from {_LONG.format(1996)} n join {_LONG.format(1995)} p on n.fixture = p.fixture and n.metric = p.metric"))
def deltas_long(spark, sf_dir):
    now, before = _scores(spark, sf_dir)
    return quality.deltas_long(now, before)


@register(
    "composite",
    with_views("scores", select="""select fixture, year, case when n % 7 = 0 then 0.0 else round(greatest(0.0, least(1.0, 0.30 * blurred + 0.10 * greatest(0.0, histogram) + 0.30 * recall + 0.20 * case when n % 3 = 0 then recall else 1.0 - blurred / 2 end
+ 0.10 * (case when n between 5 and 30 then 0.5 else 0.0 end + case when n % 2 = 0 then 0.5 else 0.0 end))), 4) end as score from scores"""),
)
def composite(spark, sf_dir):
    s = view(spark, sf_dir, "scores")
    cer = F.when(F.col("n") % 3 != 0, F.col("blurred") / 2)
    score = quality.composite(F.col("n") % 7 != 0, F.col("blurred"), F.col("histogram"), F.col("recall"), cer, quality.in_range(F.col("n"), F.lit(5), F.lit(30)), F.col("n") % 2 == 0)
    return s.select("fixture", "year", score.alias("score"))


@register(
    "keyword_recall",
    """with d as (select conv_id, string_agg(text, ' ' order by turn) as text from conversations where role = 'assistant' group by conv_id),
w as (select distinct conv_id, unnest(regexp_extract_all(text, '[^\\x09-\\x0D ]+')) as keyword from conversations where role = 'user'),
t as (select w.conv_id, w.keyword, contains(coalesce(regexp_replace(d.text, '[\\x09-\\x0D ]+', '', 'g'), ''), w.keyword) as ok from w left join d using (conv_id))
select conv_id, cast(count(*) filter (ok) as int) as found, cast(count(*) as int) as expected, count(*) filter (ok) / count(*) as recall, coalesce(list(keyword order by keyword) filter (not ok), []) as missing from t group by conv_id""",
)
def keyword_recall(spark, sf_dir):
    """Words of the user's turns sought in the answers of the conversation."""
    turns = view(spark, sf_dir, "conversations")
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))
    docs = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(said, lambda t: t["text"]), " ").alias("text"))
    words = turns.where("role = 'user'").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x09-\x0D ]+"), F.lit(0))).alias("keyword"))
    return quality.keyword_recall(docs, words, ["conv_id"])


@register("cer")
def cer(spark, sf_dir):
    """Each turn against the one before it; held against a plain loop in tests, as DuckDB's edit distance counts bytes."""
    from pyspark.sql.window import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = view(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("ref")).where("ref is not null")
    return rows.select("conv_id", "turn", quality.cer(F.col("text"), F.col("ref")).alias("cer"), quality.extra_ratio(F.col("text"), F.col("ref")).alias("extra"))


@register(
    "structural_qa",
    """with p as (select l_suppkey as k, case when l_linenumber = 1 then 'slide' when l_returnflag = 'R' then 'media' else 'run' end as kind, cast(l_quantity as int) % 9 as size, l_partkey % 10 = 0 as ph from lineitem),
a as (select k, count(*) filter (kind = 'slide') as slides, count(*) filter (kind = 'media') as media, count(*) filter (kind = 'run') as runs, count(*) filter (kind = 'run' and ph) as placeholders, count(*) filter (kind = 'media' and size = 0) as empty_media from p group by k)
select *, list_filter([case when slides = 0 then 'no slides' end, case when runs = 0 then 'no text' end, case when placeholders > 0 then 'placeholder text' end, case when empty_media > 0 then 'empty media' end], lambda x: x is not null) as failures,
slides > 0 and runs > 0 and placeholders = 0 and empty_media = 0 as ok from a""",
)
def structural_qa(spark, sf_dir):
    kind = F.expr("case when l_linenumber = 1 then 'slide' when l_returnflag = 'R' then 'media' else 'run' end")
    parts = view(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), kind.alias("kind"), (F.col("l_quantity").cast("int") % 9).alias("size"), (F.col("l_partkey") % 10 == 0).alias("placeholder"))
    return quality.structural_qa(parts, ["k"])


@register(
    "tile_means",
    with_views("li_boxes", select="""select page_id % 100 as k, tx, ty, avg(v) as mean, count(*) as n from (select page_id, v, x // 80 - i as tx, y // 80 - j as ty from (select page_id, x1 as x, y1 as y, x2 - x1 as v from li_boxes) p
cross join (select unnest([0, 1]) as i) a cross join (select unnest([0, 1]) as j) b) t where tx >= 0 and ty >= 0 group by all having avg(v) >= 5"""),
)
def tile_means(spark, sf_dir):
    return quality.tile_means(_points(spark, sf_dir), ["k"])


def _points(spark, sf_dir):
    return view(spark, sf_dir, "li_boxes").select((F.col("page_id") % 100).alias("k"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("v"))


@register("worst_regions")
def worst_regions(spark, sf_dir):
    """The three worst tiles of each page group after suppression; held against a plain loop in tests."""
    return quality.worst_regions(_points(spark, sf_dir), ["k"])


@register("sec_per_page", with_views("jobs", select="select mode, avg(duration_seconds / page_count) as seconds, count(*) as n from (select *, row_number() over (partition by mode order by finished_at desc, id desc) as rn from jobs where status = 'done' and page_count > 0 and duration_seconds > 0) x where rn <= 20 group by mode"))
def sec_per_page(spark, sf_dir):
    return jobs.sec_per_page(view(spark, sf_dir, "jobs"))


@register(
    "eta",
    with_views("jobs", select=""", r as (select mode, avg(duration_seconds / page_count) as s from (select *, row_number() over (partition by mode order by finished_at desc, id desc) as rn from jobs where status = 'done' and page_count > 0 and duration_seconds > 0) x where rn <= 20 group by mode),
j as (select jobs.*, greatest(page_count - current_page, 1) * coalesce(nullif(r.s, 0), case jobs.mode when 'full' then 60.0 when 'text-only' then 25.0 else 60.0 end) as own from jobs left join r using (mode)),
q as (select created_at, count(*) as n, sum(own) as s from j where status = 'queued' group by created_at),
u as (select (select count(*) from j where status = 'running') as n_run, (select coalesce(sum(own), 0) from j where status = 'running') as s_run)
select id, case when status in ('queued', 'running') then (select coalesce(sum(n), 0) from q where q.created_at < j.created_at) + n_run - case when status = 'running' then 1 else 0 end else 0 end as queue_position,
case when status in ('queued', 'running') then trunc(round((select coalesce(sum(s), 0) from q where q.created_at < j.created_at) + s_run + case when status = 'running' then 0 else own end, 6)) else 0 end as eta_seconds from j cross join u""").replace(") , r as", "), r as"),
)
def eta(spark, sf_dir):
    return jobs.eta(view(spark, sf_dir, "jobs"))


@register("quota_counts", with_views("jobs", select="select owner_id, count(*) filter (status in ('queued', 'running')) as active, count(*) filter (status = 'queued') as queued, count(*) filter (status = 'running') as running, count(*) filter (status in ('queued', 'running')) < 5 as admitted from jobs group by owner_id"))
def quota_counts(spark, sf_dir):
    return jobs.quota_counts(view(spark, sf_dir, "jobs"), 5)


@register("retention_filter", with_views("jobs", select="select id from jobs where status in ('done', 'failed', 'canceled') and finished_at < timestamp '1996-01-01' - interval 30 day"))
def retention_filter(spark, sf_dir):
    return jobs.retention_filter(view(spark, sf_dir, "jobs"), F.lit("1996-01-01").cast("timestamp"), 30).select("id")


@register("boot_recover", with_views("jobs", select="select id, case when status = 'running' then 'failed' else status end as status, case when status = 'running' then 'interrupted by restart' end as error_msg, case when status = 'queued' then row_number() over (partition by owner_id, status order by created_at, id) end as owner_turn from jobs"))
def boot_recover(spark, sf_dir):
    return jobs.boot_recover(view(spark, sf_dir, "jobs")).select("id", "status", "error_msg", "owner_turn")


@register("owner_filter", with_views("jobs", select="select id, status from jobs where owner_id = 7"))
def owner_filter(spark, sf_dir):
    return jobs.owner_filter(view(spark, sf_dir, "jobs"), 7).select("id", "status")


@register(
    "job_outcome",
    with_views("jobs", select="""select id, case when id % 5 <> 0 and id % 7 <> 0 then 'done' else 'failed' end as status, case when id % 5 <> 0 and id % 7 <> 0 then 100 end as progress_pct, case when id % 5 <> 0 and id % 7 <> 0 then page_count end as current_page,
greatest(1, duration_seconds) as duration_seconds, case when id % 5 = 0 then concat('exited with code ', cast(id % 3 + 1 as varchar)) when id % 7 = 0 then 'no output was written' end as error_msg from jobs"""),
)
def job_outcome(spark, sf_dir):
    runs = view(spark, sf_dir, "jobs").select("id", "page_count", F.expr("case when id % 5 = 0 then id % 3 + 1 else 0 end").alias("exit_code"), F.expr("id % 7 <> 0").alias("has_output"), F.col("created_at").alias("started_at"), F.expr("timestampadd(second, duration_seconds, created_at)").alias("finished_at"))
    return jobs.job_outcome(runs).select("id", "status", "progress_pct", "current_page", "duration_seconds", "error_msg")


@register(
    "progress",
    with_views("log", select=""", p as (select job_id, seq, case when starts_with(line, '===') then least(95, cast(floor(cast(regexp_extract(line, '(\\d+)/', 1) as int) * 100.0 / 5) as int)) end as pct, case when starts_with(line, 'page') then cast(regexp_extract(line, 'page (\\d+)', 1) as int) end as pg from log)
select job_id, seq, coalesce(last_value(pct ignore nulls) over w, 0) as percent, coalesce(max(pg) over w, 0) as page from p window w as (partition by job_id order by seq rows between unbounded preceding and current row)""").replace(") , p as", "), p as"),
)
def progress(spark, sf_dir):
    return jobs.progress(view(spark, sf_dir, "log"))


@register("log_tail", with_views("log", select="select job_id, string_agg(line, chr(10) order by seq) as tail, count(*) as n from (select *, row_number() over (partition by job_id order by seq desc) as rn from log) x where rn <= 200 group by job_id"))
def log_tail(spark, sf_dir):
    return jobs.log_tail(view(spark, sf_dir, "log"))


@register("sliding_limit")
def sliding_limit(spark, sf_dir):
    """Two events a minute and user; held against a plain loop in tests."""
    return jobs.sliding_limit(view(spark, sf_dir, "events"), 2)


_OVER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_PAIRS = f"from li_boxes a join li_boxes b on a.page_id = b.page_id and a.idx < b.idx and {_OVER} > 0"


def _overlaps(spark, sf_dir, boxes=None):
    boxes = view(spark, sf_dir, "li_boxes") if boxes is None else boxes
    a, b = Box.of("_a"), Box.of("_b")
    from quire.functions.geometry import intersection

    return boxes, spatial.box_pairs(boxes, boxes).where((F.col("idx_a") < F.col("idx_b")) & (intersection(a, b) > 0))


@register("overlap_pairs", with_views("li_boxes", select=f"select a.page_id, a.idx as a, b.idx as b, {_OVER} as area {_PAIRS}"))
def overlap_pairs(spark, sf_dir):
    from quire.functions.geometry import intersection

    _, pairs = _overlaps(spark, sf_dir)
    return pairs.select("page_id", F.col("idx_a").alias("a"), F.col("idx_b").alias("b"), intersection(Box.of("_a"), Box.of("_b")).alias("area"))


@register(
    "components",
    with_views("li_boxes", select="""select n as node, min(m) as component from (with recursive e as (select a.page_id * 100 + a.idx as s, b.page_id * 100 + b.idx as t from li_boxes a join li_boxes b on a.page_id = b.page_id and a.idx < b.idx
and least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1)), u as (select s, t from e union select t, s from e), r(n, m) as (select s, s from u union select u.t, r.m from r join u on u.s = r.n where r.m < u.t or true) select * from r) x group by n"""),
)
def components(spark, sf_dir):
    """Boxes of a page that overlap in chains."""
    _, pairs = _overlaps(spark, sf_dir)
    node = lambda c: F.col("page_id") * 100 + F.col(c)
    return graph.components(pairs.select(node("idx_a").alias("src"), node("idx_b").alias("dst")))


@register("greedy_suppress")
def greedy_suppress(spark, sf_dir):
    """Boxes that a pass by area keeps; held against a plain loop in tests."""
    boxes, pairs = _overlaps(spark, sf_dir, stored(view(spark, sf_dir, "li_boxes").select("page_id", "idx", *spatial.SIDES)))
    rows = boxes.withColumn("order", -Box.of().area)
    both = pairs.select(F.col("page_id").alias("page_id_a"), "idx_a", F.col("page_id").alias("page_id_b"), "idx_b")
    return greedy.greedy_suppress(rows, both, ["page_id", "idx"], ["order"]).select("page_id", "idx")


@register("greedy_colour")
def greedy_colour(spark, sf_dir):
    """A colour for each box that no overlapping one has; held against its rule in tests."""
    boxes, pairs = _overlaps(spark, sf_dir)
    both = pairs.select("page_id", F.col("idx_a").alias("idx"), F.col("idx_b").alias("other")).union(pairs.select("page_id", F.col("idx_b"), F.col("idx_a")))
    near = both.groupBy("page_id", "idx").agg(F.collect_set("other").alias("conflicts"))
    return greedy.greedy_colour(boxes.join(near, ["page_id", "idx"], "left"))


@register("components_capped")
def components_capped(spark, sf_dir):
    """Overlapping boxes joined while their heights stay within 1.6 times; held against a plain loop in tests."""
    boxes, pairs = _overlaps(spark, sf_dir)
    near = pairs.groupBy("page_id", F.col("idx_a").alias("idx")).agg(F.collect_set("idx_b").alias("partners"))
    return greedy.components_capped(boxes.withColumn("size", F.col("y2") - F.col("y1")).join(near, ["page_id", "idx"], "left"))


@register("fuzzy_group")
def fuzzy_group(spark, sf_dir):
    """Boxes of a page grouped with the first like seed; held against a plain loop in tests."""
    b = view(spark, sf_dir, "li_boxes")
    rows = b.select("page_id", "idx", (F.col("idx") % 3).alias("bucket"), (F.col("kind") == "text").alias("cjk"), (F.col("x1") % 256).alias("r"), (F.col("y1") % 256).alias("g"), F.lit(0).alias("b"), (F.col("y2") - F.col("y1")).alias("height"))
    return greedy.fuzzy_group(rows)


@register(
    "propagate_confident",
    with_views("li_boxes", select=""", c as (select page_id, x1 % 5 as v, count(*) as n, min(idx) as f from li_boxes where confidence >= 0.8 group by all), m as (select page_id, arg_max(v, n * 1000 - f) as mode from c group by page_id)
select b.page_id, b.idx, case when confidence >= 0.8 then x1 % 5 else coalesce(mode, x1 % 5) end as v from li_boxes b left join m on b.page_id = m.page_id""").replace(") , c as", "), c as"),
)
def propagate_confident(spark, sf_dir):
    rows = view(spark, sf_dir, "li_boxes").withColumn("v", F.col("x1") % 5)
    return greedy.propagate_confident(rows, ["page_id"], "v", least=0.8).select("page_id", "idx", "v")


@register("majority_bold", with_views("li_boxes", select="select b.page_id, b.idx, 2 * count(*) filter (kind = 'image') over (partition by page_id) >= count(*) over (partition by page_id) as bold from li_boxes b"))
def majority_bold(spark, sf_dir):
    rows = view(spark, sf_dir, "li_boxes").withColumn("bold", F.col("kind") == "image")
    return greedy.majority(rows, ["page_id"], "bold").select("page_id", "idx", "bold")


_VEC = "list_transform(embedding, lambda x: cast(trunc(x * 100) as int))"
_EMB = f"p as (select a.vec_id, {_VEC.replace('embedding', 'a.embedding')} as u, {_VEC.replace('embedding', 'b.embedding')} as v from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def _vectors(spark, sf_dir):
    """Each vector in whole hundredths, beside the one of the next id."""
    e = view(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x * 100).cast("int")).alias("u"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v")), "vec_id")


@register("match_ratio", f"with {_EMB} select vec_id, len(list_filter(u, lambda x, i: x = v[i])) / greatest(len(u), 1) as exact, len(list_filter(u, lambda x, i: abs(x - v[i]) <= 10)) / greatest(len(u), 1) as near from p")
def match_ratio(spark, sf_dir):
    """Share of equal and of close places of neighbouring vectors."""
    rows = _vectors(spark, sf_dir)
    return rows.select("vec_id", quality.match_ratio(F.col("u"), F.col("v"), 0).alias("exact"), quality.match_ratio(F.col("u"), F.col("v"), 10).alias("near"))


_BIN = "greatest(0, least(15, cast(floor((x + 40) * 16.0 / 80) as int)))"


@register(
    "hist_corr",
    f"""with {_EMB}, h as (select vec_id, list_transform(range(16), lambda i: len(list_filter(list_transform(u, lambda x: {_BIN}), lambda y: y = i))) as a, list_transform(range(16), lambda i: len(list_filter(list_transform(v, lambda x: {_BIN}), lambda y: y = i))) as b from p),
e as (select vec_id, unnest(a) as x, unnest(b) as y from h) select vec_id, round(case when var_pop(x) > 0 and var_pop(y) > 0 then corr(x, y) else 0.0 end, 6) as r from e group by vec_id""",
)
def hist_corr(spark, sf_dir):
    """Correlation of the 16-bin histograms of neighbouring vectors."""
    bins = lambda c: quality.histogram(F.col(c), -40, 40)
    counts = _vectors(spark, sf_dir).withColumns({"a": bins("u"), "b": bins("v")})
    return counts.select("vec_id", F.round(quality.correlation(F.col("a"), F.col("b")), 6).alias("r"))


def _slots(spark, sf_dir):
    """Texts with a style, a size and a weight, and the classes of those in one column of an image."""
    boxes = stored(view(spark, sf_dir, "li_boxes").select("page_id", "idx", "kind", *spatial.SIDES))
    texts = boxes.where("kind = 'text'").withColumns({"style": F.lit(0), "size": F.col("y2") - F.col("y1"), "bold": F.col("idx") % 2 == 0, "align": F.element_at(F.array(F.lit("left"), F.lit("right")), (F.col("x1") % 2 + 1).cast("int"))})
    contains = spatial.containment_join(texts, boxes.where("kind = 'image'"))
    return texts, slots.pair_edges(texts, contains, column_gap=60)


@register("size_class")
def size_class(spark, sf_dir):
    texts, edges = _slots(spark, sf_dir)
    return slots.size_class(texts, slots.slot_classes(edges))


@register("slot_report")
def slot_report(spark, sf_dir):
    texts, edges = _slots(spark, sf_dir)
    return slots.slot_report(texts, slots.slot_classes(edges))


@register(
    "build_layout",
    with_views("li_boxes", select="""select page_id, list_concat([{'type': 'image', 'name': 'background', 'box': [0, 0, 640, 520]}], list({'type': kind, 'name': concat(kind, '_', cast(idx as varchar)), 'box': [x1, y1, x2 - x1, y2 - y1]} order by idx)) as elements from li_boxes group by page_id"""),
)
def build_layout(spark, sf_dir):
    return slots.build_layout(view(spark, sf_dir, "li_boxes"), 640, 520)


@register("band_filter", with_views("li_boxes", select="select page_id, idx from (select *, y2 - y1 as h, (x2 - x1) / 640.0 as span, max(y2 - y1) over (partition by page_id) as t from li_boxes) x where not (h <= cast(0.32 as double) * t and span >= 0.3)"))
def band_filter(spark, sf_dir):
    rows = view(spark, sf_dir, "li_boxes").withColumns({"height": F.col("y2") - F.col("y1"), "span": (F.col("x2") - F.col("x1")) / 640.0})
    return islands.band_filter(rows, ["page_id"], wide=0.3).select("page_id", "idx")
