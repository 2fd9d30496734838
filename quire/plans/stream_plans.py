"""Queries that run a streaming plan over the tables in batch mode."""

from __future__ import annotations

from quire.plans.catalogue import register
from quire.plans.views import table
from quire.streaming import jobs


@register("windowed_counts", """select to_timestamp(floor(epoch(ts) / 600) * 600) at time zone 'UTC' as start, to_timestamp(floor(epoch(ts) / 600) * 600 + 600) at time zone 'UTC' as "end", event_type, count(*) as n from events group by all""")
def windowed_counts(spark, sf_dir):
    """Events by kind in windows of ten minutes."""
    return jobs.windowed_counts(table(spark, sf_dir, "events"))


@register(
    "session_counts",
    """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as k from g) select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k""",
)
def session_counts(spark, sf_dir):
    """Sessions of each user, 30 minutes apart."""
    return jobs.session_counts(table(spark, sf_dir, "events"))
