"""The library's inputs seen through the driver's tables: boxes, jobs, logs, lines, votes, scores.

Each view exists twice: as a DataFrame, and as a common table expression that
DuckDB runs on the same tables. ``with_views`` puts the expressions before a
SELECT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LI_BOXES = """
select l_orderkey as page_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as idx,
  case when l_returnflag = 'R' then 'image' else 'text' end as kind,
  cast(l_partkey * 7 % 640 as int) as x1, cast(l_suppkey * 37 % 360 as int) as y1,
  cast(l_partkey * 7 % 640 + 20 + 8 * cast(l_quantity as int) as int) as x2,
  cast(l_suppkey * 37 % 360 + 16 + 4 * (l_partkey % 40) as int) as y2,
  (100 - cast(l_discount * 100 as int) * 5) / 100.0 as confidence
from lineitem"""

_JOBS = """
select o.o_orderkey as id, o.o_custkey as owner_id,
  case when o.o_orderpriority in ('1-URGENT', '2-HIGH') then 'full' else 'text-only' end as mode,
  case when o.o_orderstatus = 'F' and o.o_orderkey % 17 = 0 then 'failed' when o.o_orderstatus = 'F' then 'done'
       when o.o_orderstatus = 'P' and o.o_orderkey % 10 = 0 then 'running' else 'queued' end as status,
  cast(coalesce(l.n, 0) as int) as page_count,
  cast(case when o.o_orderstatus = 'P' and o.o_orderkey % 10 = 0 then coalesce(l.f, 0) else 0 end as int) as current_page,
  cast(floor(o.o_totalprice / 1000) as int) as duration_seconds, cast(o.o_orderdate as timestamp) as created_at, cast(l.lastship as timestamp) as finished_at
from orders o left join (select l_orderkey, count(*) as n, sum(case when l_linestatus = 'F' then 1 else 0 end) as f, max(l_shipdate) as lastship
                         from lineitem group by l_orderkey) l on o.o_orderkey = l.l_orderkey"""

_LOG = """
select user_id as job_id, event_id as seq, ts,
  case when event_type = 'view' then concat('page ', cast(event_id % 9 + 1 as string), ': ok')
       when event_type = 'click' then concat('=== ', cast(event_id % 5 + 1 as string), '/5  stage')
       else concat('note ', event_type) end as line
from events"""

_WORD_BOXES = """
select doc_id as page_id, ln, wn, w as text,
  cast(8 * (sum(length(w) + 1) over (partition by doc_id, ln order by wn) - length(w) - 1) as bigint) as x1,
  cast(8 * (sum(length(w) + 1) over (partition by doc_id, ln order by wn) - 1) as bigint) as x2,
  cast(24 * ln as bigint) as y1, cast(24 * ln + 16 as bigint) as y2
from words where w <> ''"""

_VOTES = """
select doc_id, ln, k,
  case when k = 1 then line when (doc_id + ln) % 3 = 0 then line when (doc_id + ln) % 3 = 1 and k = 2 then translate(line, 'aeiou', 'AEIOU')
       when (doc_id + ln) % 3 = 1 or k = 2 then substring(line, 1, greatest(length(line) - 1, 0)) else translate(line, 'aeiou', 'AEIOU') end as txt,
  ((doc_id * 31 + ln * 17 + k * 53) % 100) / 100.0 as conf
from lines cross join (select 1 as k union all select 2 union all select 3) z"""

_SCORES = """
select s_suppkey as fixture, y as year,
  least(round(avg(q) / 60, 4), cast(1 as double)) as composite, round(avg(d) * 10, 4) as blurred, round(avg(t) * 10, 4) as histogram, round(avg(f), 4) as recall, count(*) as n
from (select l_suppkey as s_suppkey, year(l_shipdate) as y, cast(l_quantity as double) as q, cast(l_discount as double) as d, cast(l_tax as double) as t,
             cast(case when l_returnflag = 'N' then 1.0 else 0.5 end as double) as f from lineitem) x
group by s_suppkey, y"""

_DUCK = {
    "li_boxes": _LI_BOXES,
    "jobs": _JOBS,
    "log": _LOG,
    "lines": "select doc_id, unnest(range(len(string_split(text, chr(10))))) as ln, unnest(string_split(text, chr(10))) as line from documents",
    "words": "select doc_id, ln, unnest(range(len(string_split(line, ' ')))) as wn, unnest(string_split(line, ' ')) as w from lines",
    "word_boxes": _WORD_BOXES,
    "votes": _VOTES,
    "scores": _SCORES,
}
_SPARK = {
    "li_boxes": _LI_BOXES,
    "jobs": _JOBS,
    "log": _LOG,
    "lines": "select doc_id, posexplode(split(text, '\\n')) as (ln, line) from documents",
    "words": "select doc_id, ln, posexplode(split(line, ' ')) as (wn, w) from lines",
    "word_boxes": _WORD_BOXES,
    "votes": _VOTES,
    "scores": _SCORES,
}
_NEEDS = {"words": ["lines"], "word_boxes": ["lines", "words"], "votes": ["lines"]}
_TABLES = {"li_boxes": ["lineitem"], "jobs": ["orders", "lineitem"], "log": ["events"], "lines": ["documents"], "words": ["documents"], "word_boxes": ["documents"], "votes": ["documents"], "scores": ["lineitem"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, or a table of the driver."""
    if name not in _SPARK:
        return table(spark, sf_dir, name)
    parts = [f"{n} as ({_SPARK[n]})" for n in _NEEDS.get(name, [])]
    query = (f"with {', '.join(parts)} " if parts else "") + _SPARK[name]
    tables = {t: table(spark, sf_dir, t) for t in _TABLES[name]}
    for t in tables:
        query = query.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(query, **tables)


def with_views(*names: str, select: str) -> str:
    """DuckDB SQL: ``select`` with the named views in front."""
    wanted = [n for n in _DUCK if n in {*names, *(x for m in names for x in _NEEDS.get(m, []))}]
    return "with " + ", ".join(f"{n} as ({_DUCK[n]})" for n in wanted) + " " + select
