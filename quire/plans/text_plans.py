"""Queries over lines and votes: repeats, review and consensus."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.text import CJK, CJK_WIDE, PUNCTUATION_FROM, PUNCTUATION_TO
from quire.operators import consensus, repeat, rules
from quire.plans.catalogue import register
from quire.plans.views import view, with_views

_STRIP = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
_WIDE = "len(regexp_extract_all({0}, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}\\x{{F900}}-\\x{{FAFF}}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7A3}}\\x{{FF00}}-\\x{{FFEF}}]'))"
_WEIGHTED = f"length(text) + {_WIDE.format('text')}"
_ASCII = "not regexp_matches({0}, '[^\\x00-\\x7F]')"


def _duck(chars: str) -> str:
    """A character class of Java in DuckDB's regular expressions."""
    return re.sub(r"\\u(\w{4})", r"\\x{\1}", chars)


#: White space and other blanks that ``strip`` removes.
_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _line_boxes(spark, sf_dir):
    """Lines as boxes of a page: the document, with the line number as both centres."""
    return view(spark, sf_dir, "lines").select(F.col("doc_id").alias("page_id"), F.col("ln").alias("idx"), F.col("line").alias("text"), F.col("ln").alias("cx"), F.col("ln").alias("cy"))


_OCC = f"occ as (select doc_id, ln, {_STRIP} as text from lines)"


@register(
    "template_repeat",
    with_views("lines", select=f""", {_OCC}, kept as (select * from occ where text <> '' and {_WEIGHTED} <= 60)
select text, count(distinct doc_id) as pages, (select count(distinct doc_id) from lines) as total_pages,
  cast(trunc(quantile_cont(ln, 0.5)) as int) as med_x, cast(trunc(quantile_cont(ln, 0.5)) as int) as med_y
from kept group by text having count(distinct doc_id) >= 2 and max(ln) - min(ln) <= 5""").replace(") , occ", "), occ"),
)
def template_repeat(spark, sf_dir):
    """Short lines at about the same line number of two or more documents."""
    return repeat.template_repeat(_line_boxes(spark, sf_dir), min_pages=2, min_ratio=0.0, tolerance=5, max_length=60)


@register(
    "repeat_candidates",
    with_views("lines", select=f""", {_OCC}
select text, count(distinct doc_id) as pages, count(*) as occurrences, max(ln) - min(ln) as x_range, max(ln) - min(ln) as y_range
from occ where text <> '' group by text having count(distinct doc_id) >= 2""").replace(") , occ", "), occ"),
)
def repeat_candidates(spark, sf_dir):
    return repeat.repeat_candidates(_line_boxes(spark, sf_dir))


@register(
    "whitelist_flag",
    with_views("lines", select=f"""select doc_id as page_id, ln as idx from lines
where {_STRIP} in (select string_split(text, chr(10))[1] from documents) and {_STRIP} <> '' and not starts_with({_STRIP}, '#')"""),
)
def whitelist_flag(spark, sf_dir):
    """Lines that equal the first line of a document."""
    words = view(spark, sf_dir, "documents").select(F.get(F.split("text", "\n"), F.lit(0)).alias("text"))
    return repeat.whitelist_flag(_line_boxes(spark, sf_dir), words).select("page_id", "idx")


@register(
    "flag_union",
    with_views("lines", select="""select doc_id as page_id, ln as idx, (length(line) % 7 = 0 or ln = 0) as preserve_visual from lines"""),
)
def flag_union(spark, sf_dir):
    boxes = _line_boxes(spark, sf_dir)
    return repeat.flag_union(boxes, boxes.where("length(text) % 7 = 0"), boxes.where("idx = 0")).select("page_id", "idx", "preserve_visual")


_CONF = "((doc_id * 31 + ln * 17) % 100) / 100.0"
_TIER = f"case when {_CONF} >= 0.95 then 'green' when {_CONF} >= 0.85 then 'yellow' else 'red' end"


def _entries(spark, sf_dir):
    """Lines with a confidence, its tier, and a rule that clears short lines."""
    conf = F.expr("((doc_id * 31 + ln * 17) % 100) / 100.0")
    rows = view(spark, sf_dir, "lines").withColumn("confidence", conf)
    return rows.select(F.col("doc_id").alias("page_id"), F.col("ln").alias("idx"), F.col("line").alias("text"), "confidence", repeat.tier_of(F.col("confidence")).alias("tier"), F.when(F.length("line") < 8, "short").alias("rule"))


@register("tier_rollup", with_views("lines", select=f"select doc_id as page_id, {_TIER} as tier, count(*) as n from lines group by rollup(doc_id, {_TIER})"))
def tier_rollup(spark, sf_dir):
    """Counts by page and tier, with totals, in one pass."""
    return repeat.counts_rollup(_entries(spark, sf_dir), "page_id", "tier")


@register(
    "review_pending",
    with_views("lines", select=f"""select doc_id as page_id, count(*) filter ({_TIER} = 'yellow') as yellow, count(*) filter ({_TIER} = 'red') as red
from lines where length(line) >= 8 and {_TIER} in ('yellow', 'red') group by rollup(doc_id)"""),
)
def review_pending(spark, sf_dir):
    return repeat.review_pending(_entries(spark, sf_dir))


@register(
    "review_topk",
    """with b as (select l_orderkey as page_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as idx, (100 - cast(l_discount * 100 as int) * 5) / 100.0 as confidence from lineitem),
r as (select *, row_number() over (partition by page_id order by confidence, idx) as rank from b where confidence < 0.95)
select page_id, idx, confidence, rank from r where rank <= 3""",
)
def review_topk(spark, sf_dir):
    """The three least confident boxes of each page."""
    return repeat.review_topk(view(spark, sf_dir, "li_boxes"), 0.95, 3).select("page_id", "idx", F.col("confidence").cast("double").alias("confidence"), "rank")


_FIX = "case when ln % 5 = 0 then null when ln % 5 = 1 then line when ln % 5 = 2 then '' else concat(line, '.') end"


@register(
    "review_merge",
    with_views("lines", select=f"""select page_id, idx, case when outcome in ('confirmed', 'blanked', 'changed') then new else line end as text,
  case when outcome in ('confirmed', 'blanked', 'changed') then 1.0 else confidence end as confidence, outcome = 'blanked' as preserve_visual, outcome
from (select doc_id as page_id, ln as idx, line, {_CONF} as confidence, {_FIX} as new,
  case when ln % 3 = 2 then 'unreviewed' when ln % 11 = 0 then 'mismatch' when {_FIX} is null then 'skipped' when {_FIX} = line then 'confirmed' when {_FIX} = '' then 'blanked' else 'changed' end as outcome from lines) x"""),
)
def review_merge(spark, sf_dir):
    """A review of two lines in three, some with a changed box, merged back."""
    items = _entries(spark, sf_dir).select("page_id", "idx", "text", "confidence", F.lit(0).alias("x1"), F.col("idx").alias("y1"), F.length("text").alias("x2"), (F.col("idx") + 1).alias("y2"))
    fix = F.expr("case when idx % 5 = 0 then null when idx % 5 = 1 then text when idx % 5 = 2 then '' else concat(text, '.') end")
    review = items.where("idx % 3 <> 2").select("page_id", "idx", fix.alias("corrected_text"), "x1", F.when(F.col("idx") % 11 == 0, -1).otherwise(F.col("y1")).alias("y1"), "x2", "y2")
    return repeat.review_merge(items, review).select("page_id", "idx", "text", F.col("confidence").cast("double").alias("confidence"), "preserve_visual", "outcome")


_PLAIN = "translate(regexp_replace({0}, '[\\x09-\\x0D ]+', '', 'g'), '" + PUNCTUATION_FROM + "', '" + PUNCTUATION_TO.replace("'", "''") + "')"
_NORM = f"case when {_ASCII.format(_PLAIN)} then lower({_PLAIN}) else {_PLAIN} end"
_CJK_TEXT = "length({0}) > 0 and 2 * len(regexp_extract_all({0}, '[" + _duck(CJK).replace("{", "{{").replace("}", "}}") + "]')) >= length({0})"


def _one_edit(a: str, b: str) -> str:
    """At most one edit apart: equal but for one character behind the common start. DuckDB's own distance counts bytes."""
    same = f"coalesce(nullif(list_position(list_transform(list_zip(string_split({a}, ''), string_split({b}, '')), lambda z: z[1] is not distinct from z[2]), false), 0) - 1, least(length({a}), length({b})))"
    rest = lambda x, more: f"substring({x}, cast({same} + {more} as bigint))"
    return f"""case when {a} = {b} then true when abs(length({a}) - length({b})) > 1 then false when length({a}) = length({b}) then {rest(a, 2)} = {rest(b, 2)}
      when length({a}) > length({b}) then {rest(a, 2)} = {rest(b, 1)} else {rest(a, 1)} = {rest(b, 2)} end"""


_WIDE_VOTES = f"""w as (select doc_id, ln, max(txt) filter (k = 1) as t1, max(conf) filter (k = 1) as c1, max(txt) filter (k = 2) as t2, max(conf) filter (k = 2) as c2,
  max(txt) filter (k = 3) as t3, max(conf) filter (k = 3) as c3 from votes group by doc_id, ln),
n as (select *, {_NORM.format("t1")} as n1, {_NORM.format("t2")} as n2, {_NORM.format("t3")} as n3, coalesce(nullif(t1, ''), nullif(t2, ''), t3) as ref,
  c1 >= 0.95 and t1 <> '' as ok1, c2 >= 0.95 and t2 <> '' as ok2, c3 >= 0.95 and t3 <> '' as ok3 from w),
q as (select *, case when {_CJK_TEXT.format("ref")} and t1 <> '' and c1 >= 0.30 then 1
    when not ({_CJK_TEXT.format("ref")}) and {_ASCII.format("ref")} and trim(ref) <> '' and t3 <> '' and c3 >= 0.30 then 3
    when t1 <> '' and c1 >= case when t2 <> '' then c2 else -1 end and c1 >= case when t3 <> '' then c3 else -1 end then 1
    when t2 <> '' and c2 >= case when t3 <> '' then c3 else -1 end then 2 when t3 <> '' then 3 else 1 end as b,
  case when ok1 and (not ok2 or length(t1) >= length(t2)) and (not ok3 or length(t1) >= length(t3)) then t1 when ok2 and (not ok3 or length(t2) >= length(t3)) then t2 else t3 end as longest from n),
p as (select *, case b when 1 then t1 when 2 then t2 else t3 end as best, case b when 1 then c1 when 2 then c2 else c3 end as bestc from q),
v as (select *, case when n1 = '' and n2 = '' and n3 = '' then 'C_all_empty' when n1 <> '' and n1 = n2 and n2 = n3 then 'A_strict_consensus'
    when (n1 <> '' and (n1 = n2 or n1 = n3)) or (n2 <> '' and n2 = n3) then 'B_majority'
    when least(length(n1), length(n2), length(n3)) >= 3 and {_one_edit("n1", "n2")} and {_one_edit("n1", "n3")} and {_one_edit("n2", "n3")} then 'D_edit_close'
    when ok1 or ok2 or ok3 then 'D_prime_single_high_conf'
    when bestc >= 0.85 then 'G_moderate_conf_fallback' else 'F_disagree' end as reason from p),
x as (select *, case when reason = 'C_all_empty' then '' when reason = 'A_strict_consensus' then ref
    when reason = 'B_majority' and n1 = n2 and n1 <> '' then case when c1 >= c2 then t1 else t2 end
    when reason = 'B_majority' and n1 = n3 and n1 <> '' then case when c1 >= c3 then t1 else t3 end
    when reason = 'B_majority' then case when c2 >= c3 then t2 else t3 end
    when reason = 'D_prime_single_high_conf' then case when {_CJK_TEXT.format("longest")} and ok1 then t1 when {_ASCII.format("longest")} and ok3 then t3
      when ok1 and (not ok2 or c1 >= c2) and (not ok3 or c1 >= c3) then t1 when ok2 and (not ok3 or c2 >= c3) then t2 else t3 end
    else best end as suggested_text,
  case when reason in ('C_all_empty', 'A_strict_consensus', 'B_majority') then 'green' when reason = 'F_disagree' then 'red' else 'yellow' end as tier from v)"""


def _wide(spark, sf_dir):
    votes = view(spark, sf_dir, "votes")
    aggs = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{n}{k}") for k in (1, 2, 3) for c, n in (("txt", "t"), ("conf", "c"))]
    wide = votes.groupBy("doc_id", "ln").agg(*aggs)
    return wide.withColumns({f"c{k}": F.col(f"c{k}").cast("double") for k in (1, 2, 3)})


@register("cross_verify", with_views("votes", select=f", {_WIDE_VOTES} select doc_id, ln, tier, reason, suggested_text from x").replace(") , w", "), w"))
def cross_verify(spark, sf_dir):
    """Three predictions of every line brought to one."""
    return consensus.cross_verify(_wide(spark, sf_dir)).select("doc_id", "ln", "tier", "reason", "suggested_text")


@register("tier_counts", with_views("votes", select=f", {_WIDE_VOTES} select tier, reason, count(*) as n from x group by tier, reason").replace(") , w", "), w"))
def tier_counts(spark, sf_dir):
    return consensus.cross_verify(_wide(spark, sf_dir)).groupBy("tier", "reason").agg(F.count("*").alias("n"))


@register("pick_best", with_views("votes", select=f", {_WIDE_VOTES} select doc_id, ln, best as text, bestc as conf from x").replace(") , w", "), w"))
def pick_best(spark, sf_dir):
    t = [F.col(f"{n}{k}") for k in (1, 2, 3) for n in "tc"]
    return _wide(spark, sf_dir).withColumn("b", consensus.pick_best(*t)).select("doc_id", "ln", "b.text", "b.conf")


@register(
    "rescue",
    with_views("votes", select=f""", {_WIDE_VOTES},
f as (select *, case when ln % 3 = 0 then t2 when ln % 3 = 1 then concat(t1, 'x') else t1 end as t4, ((doc_id * 7 + ln * 13) % 100) / 100.0 as c4 from x),
g as (select *, case when tier <> 'red' or {_NORM.format("t4")} in ('', n1) then null when {_NORM.format("t4")} = n2 then 'G_crop_agrees_with_2' when {_NORM.format("t4")} = n3 then 'G_crop_agrees_with_3'
  when c4 >= 0.85 then 'G_crop_moderate_conf' end as up from f)
select doc_id, ln, case when up is null then tier else 'yellow' end as tier, coalesce(up, reason) as reason, case when up is null then suggested_text else t4 end as suggested_text from g""").replace(") , w", "), w"),
)
def rescue(spark, sf_dir):
    """Red rows get a fourth prediction."""
    verified = consensus.cross_verify(_wide(spark, sf_dir))
    fourth = verified.withColumns({"t4": F.expr("case when ln % 3 = 0 then t2 when ln % 3 = 1 then concat(t1, 'x') else t1 end"), "c4": F.expr("((doc_id * 7 + ln * 13) % 100) / 100.0")})
    return consensus.rescue(fourth).select("doc_id", "ln", "tier", "reason", "suggested_text")


@register(
    "vote_long",
    with_views("votes", select=f""", g as (select doc_id, ln, {_NORM.format("txt")} as norm, count(*) as votes, round(sum(conf), 4) as c, min(k) as first, arg_max(txt, conf * 100 - k / 10.0) as text from votes where {_NORM.format("txt")} <> '' group by all),
r as (select *, sum(votes) over (partition by doc_id, ln) as of, row_number() over (partition by doc_id, ln order by votes desc, c desc, first) as rn from g)
select doc_id, ln, norm, text, votes, cast(of as bigint) as of from r where rn = 1""").replace(") , g", "), g"),
)
def vote_long(spark, sf_dir):
    votes = view(spark, sf_dir, "votes").withColumn("conf", F.col("conf").cast("decimal(10,4)"))
    return consensus.vote_long(votes, ["doc_id", "ln"])


_WIDE_CJK = f"regexp_matches(s, '[{_duck(CJK_WIDE)}]')"


@register(
    "autoclear",
    with_views("lines", select=f""", b as (select doc_id as page_id, ln as idx, line as t, {_CONF} as conf, (ln * 37 % 640) / 640.0 as rx, (ln * 53 % 360) / 360.0 as ry, 8 + ln % 20 as h from lines),
s as (select *, regexp_replace(t, '^{_BLANK}+|{_BLANK}+$', '', 'g') as s from b)
select page_id, idx, case
  when regexp_matches(t, 'UNIVERSITY|UNNERTY|INSTITUTE|COLLEGE|GROUP|CORP|LTD|INC|LAB|LOGO') and (ry < 0.15 or ry > 0.85 or rx < 0.16 or rx > 0.85) then 'H1_logo_strip'
  when length(s) = 1 and {_WIDE_CJK} and conf < 0.55 then 'H2_single_cjk_lowconf'
  when s <> '' and not contains(s, '…') and s not in ('.', '..') and not regexp_matches(s, '[\\p{{L}}\\p{{N}}]') and length(s) <= 4 and conf < 0.80 then 'H3_punct_symbol_only'
  when regexp_full_match(s, '[-=>→←↑↓·•]+') and length(s) <= 6 and conf < 0.90 then 'H4_arrow_dash_fragment'
  when s <> '' and not {_WIDE_CJK} and not contains(s, '…') and s <> '.' and length(s) <= 8 and h <= 15 and conf < 0.95 and not (rx > 0.95 and ry > 0.92) then 'H5_short_thin_lowconf'
  when regexp_full_match(s, '[0-9OoDIlZ]{{1,3}}') and ry < 0.12 and (rx > 0.80 or rx < 0.15) and conf < 0.95 then 'H6_logo_digits_top_corner' end as rule from s""").replace(") , b", "), b"),
)
def autoclear(spark, sf_dir):
    """Noise rules over whole lines placed about a page of 640 by 360."""
    rows = _entries(spark, sf_dir)
    cx, cy = F.col("idx") * 37 % 640, F.col("idx") * 53 % 360
    h = 8 + F.col("idx") % 20
    boxes = rows.withColumns({"x1": cx - 10, "x2": cx + 10, "y1": cy - h / 2.0, "y2": cy + h / 2.0})
    return rules.autoclear(boxes, F.lit(640), F.lit(360)).select("page_id", "idx", "rule")


_VISIBLE = "length(regexp_replace(line, '[\\x09-\\x0D ]', '', 'g'))"


@register(
    "text_scalars",
    with_views("lines", select=f"""select doc_id, ln, {_WEIGHTED.replace("text", "line")} as weighted, {_VISIBLE} as visible,
  case when {_VISIBLE} <= 4 then 0 when {_VISIBLE} <= 12 then 1 else 2 end as bucket,
  {_NORM.format("line")} as norm, regexp_matches(line, '^[\\p{{P}}\\p{{S}}\\x09-\\x0D ]*$') as marks, contains(lower(line), 'lorem') or contains(lower(line), 'license') as placeholder
from lines"""),
)
def text_scalars(spark, sf_dir):
    """Lengths, normal form and tests of every line."""
    rows = view(spark, sf_dir, "lines")
    return rows.select("doc_id", "ln", T.weighted_length("line").alias("weighted"), T.visible("line").alias("visible"), T.length_bucket("line").alias("bucket"), T.normalise("line").alias("norm"), T.only_marks("line").alias("marks"), T.has_placeholder("line", ["lorem", "license"]).alias("placeholder"))
