"""Queues of jobs: rates, estimates, quotas, retention, progress and rate limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import small

#: Seconds a page before there is any history, and how many of the last jobs count.
DEFAULT_SECONDS = {"full": 60.0, "text-only": 25.0}
OTHER_SECONDS = 60.0
HISTORY = 20
FINAL = ("done", "failed", "canceled")
#: Fixed value: the reason of jobs that a restart ended.
INTERRUPTED = "interrupted by restart"


def sec_per_page(jobs: DataFrame, history: int = HISTORY) -> DataFrame:
    """(mode, seconds, n): mean seconds a page of each mode's last done jobs, by (finished_at, id)."""
    done = jobs.where("status = 'done' and page_count > 0 and duration_seconds > 0")
    last = Window.partitionBy("mode").orderBy(F.desc("finished_at"), F.desc("id"))
    rows = done.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= history)
    return rows.groupBy("mode").agg(F.avg(F.col("duration_seconds") / F.col("page_count")).alias("seconds"), F.count("*").alias("n"))


def _rated(jobs: DataFrame) -> DataFrame:
    """Jobs with their mode's rate and the seconds they still need."""
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_SECONDS.items() for x in kv])
    rate = F.coalesce(F.nullif("seconds", F.lit(0.0)), default[F.col("mode")], F.lit(OTHER_SECONDS))
    rates = sec_per_page(jobs).select("mode", "seconds")  # a row a mode
    return jobs.join(small(rates), "mode", "left").withColumn("own", F.greatest(F.col("page_count") - F.col("current_page"), F.lit(1)) * rate)


def eta(jobs: DataFrame) -> DataFrame:
    """(id, queue_position, eta_seconds) of all jobs; finished ones have 0 and 0.

    Ahead of a job are the running ones and the queued ones created strictly
    earlier. Sums of the queued are taken by creation time first, then running
    totals within each day, and one over the sums of the days.
    """
    rated = _rated(jobs)
    queued = rated.where("status = 'queued'").groupBy("created_at").agg(F.count("*").alias("n"), F.sum("own").alias("s"))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = past(Window.partitionBy("day").orderBy("created_at"))
    running = rated.where("status = 'running'").agg(F.count("*").alias("n_run"), F.coalesce(F.sum("own"), F.lit(0.0)).alias("s_run"))
    open_ = rated.where("status in ('queued', 'running')")
    # a running job waits for the queued ones created before it too
    times = open_.select("created_at").distinct().join(queued, "created_at", "left").select("created_at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"))
    times = times.withColumn("day", F.to_date("created_at"))
    days = times.groupBy("day").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    all_days = past(Window.orderBy("day"))  # a row a day
    days = days.select("day", F.coalesce(F.sum("n").over(all_days), F.lit(0)).alias("n_days"), F.coalesce(F.sum("s").over(all_days), F.lit(0.0)).alias("s_days"))
    upto = times.join(days, "day").select("created_at", (F.col("n_days") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("n_before"), (F.col("s_days") + F.coalesce(F.sum("s").over(before), F.lit(0.0))).alias("s_before"))
    both = open_.join(upto, "created_at").crossJoin(F.broadcast(running))
    me = F.col("status") == "running"
    place = F.col("n_before") + F.col("n_run") - me.cast("long")
    seconds = F.col("s_before") + F.col("s_run") + F.when(me, F.lit(0.0)).otherwise(F.col("own"))
    waiting = both.select("id", place.alias("queue_position"), F.round(seconds, 6).cast("long").alias("eta_seconds"))  # sums differ in their last digits by order
    rest = rated.where("status not in ('queued', 'running')").select("id", F.lit(0).cast("long").alias("queue_position"), F.lit(0).cast("long").alias("eta_seconds"))
    return waiting.union(rest)


def quota_counts(jobs: DataFrame, limit: int) -> DataFrame:
    """(owner_id, active, queued, running, admitted): may the owner enter another job?"""
    agg = jobs.groupBy("owner_id").agg(F.count_if(F.col("status").isin("queued", "running")).alias("active"), F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"))
    return agg.withColumn("admitted", F.col("active") < limit)


def retention_filter(jobs: DataFrame, now: Column, days: int) -> DataFrame:
    """Finished jobs older than ``days``; none for 0 or less."""
    old = F.col("finished_at") < now - F.make_dt_interval(F.lit(max(days, 0)))
    return jobs.where(F.lit(days > 0) & F.col("status").isin(*FINAL) & old)


def boot_recover(jobs: DataFrame) -> DataFrame:
    """After a restart: running jobs have failed, with a reason; queued ones are numbered by creation."""
    number = F.row_number().over(Window.partitionBy("owner_id").orderBy("created_at", "id"))
    out = jobs.withColumn("error_msg", F.when(F.col("status") == "running", INTERRUPTED))
    out = out.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))
    queued = out.where("status = 'queued'").withColumn("owner_turn", number)
    return queued.unionByName(out.where("status <> 'queued'"), allowMissingColumns=True)


def job_outcome(runs: DataFrame) -> DataFrame:
    """Runs (exit_code, has_output, page_count, started_at, finished_at) with their final status."""
    good = (F.col("exit_code") == 0) & F.col("has_output")
    seconds = F.greatest(F.lit(1), F.unix_timestamp("finished_at") - F.unix_timestamp("started_at"))
    return runs.withColumns(
        {
            "status": F.when(good, "done").otherwise("failed"),
            "progress_pct": F.when(good, 100),
            "current_page": F.when(good, F.col("page_count")),
            "duration_seconds": seconds.cast("int"),
            "error_msg": F.when(good, None).when(F.col("exit_code") != 0, F.format_string("exited with code %d", F.col("exit_code"))).otherwise("no output was written"),
        }
    )


def owner_filter(jobs: DataFrame, owner: int, is_admin: bool = False) -> DataFrame:
    """The jobs that a user may see, newest first."""
    return jobs.where(F.lit(is_admin) | (F.col("owner_id") == owner)).orderBy(F.desc("created_at"), F.desc("id"))


def parse_log(lines: DataFrame) -> DataFrame:
    """Log lines with the stage and page they mark: adds ``percent`` and ``page``, null where there is none."""
    stage, of = F.regexp_extract("line", r"^===\s*(\d+)/(\d+)", 1), F.regexp_extract("line", r"^===\s*(\d+)/(\d+)", 2)
    page = F.regexp_extract("line", r"^page\s+(\d+):", 1)
    percent = F.least(F.lit(95), F.floor(stage.cast("int") * 100 / F.greatest(of.cast("int"), F.lit(1)))).cast("int")
    return lines.withColumns({"percent": F.when(stage != "", percent), "page": F.when(page != "", page.cast("int"))})


def progress(lines: DataFrame) -> DataFrame:
    """(job_id, seq, percent, page): the last stage so far and the largest page so far, after each line."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = parse_log(lines)
    return rows.select("job_id", "seq", F.coalesce(F.last("percent", ignorenulls=True).over(w), F.lit(0)).alias("percent"), F.coalesce(F.max("page").over(w), F.lit(0)).alias("page"))


def log_tail(lines: DataFrame, last: int = 200) -> DataFrame:
    """(job_id, tail, n): the last lines of each job, in order."""
    w = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    rows = lines.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    text = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"])
    return rows.groupBy("job_id").agg(F.array_join(text, "\n").alias("tail"), F.count("*").alias("n"))


def sliding_limit(events: DataFrame, limit: int, window_s: float = 60, key: str = "user_id") -> DataFrame:
    """(key, event_id, ts, accepted, retry_after): an event is accepted if fewer than ``limit`` accepted ones lie in the window before it.

    Rejected events don't count, so the verdict depends on all verdicts before;
    a key's events are taken in order of (ts, event_id). A pause of a window's
    length forgets all, so a key's events are cut there into parts of their own;
    sorted parts are streamed, and a part holds ``limit`` times at most. (A key that
    never pauses stays one part.) ``ts`` may be with or without a time zone and
    keeps its type.
    """
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    new = F.coalesce((at - F.lag(at).over(order) >= window_s).cast("int"), F.lit(0))
    rows = events.select(key, "event_id", "ts").withColumn("__new", new).withColumn("__part", F.sum("__new").over(order)).withColumn("__at", at)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, deque()
        for pdf in batches:
            accepted, wait = [], []
            for k, part, t in zip(pdf[key], pdf["__part"], pdf["__at"], strict=True):
                k = None if pd.isna(k) else k
                if (k, part) != current:
                    current = k, part
                    kept.clear()
                while kept and kept[0] <= t - window_s:
                    kept.popleft()
                ok = len(kept) < limit
                accepted.append(ok)
                wait.append(0.0 if ok else kept[0] + window_s - t)
                if ok:
                    kept.append(t)
            yield pdf[[key, "event_id", "ts"]].assign(accepted=accepted, retry_after=wait)

    sorted_ = rows.repartition(key, "__part").sortWithinPartitions(key, "__part", "ts", "event_id")
    return sorted_.select(key, "event_id", "ts", "__part", "__at").mapInPandas(work, f"{key} long, event_id long, ts {events.schema['ts'].dataType.simpleString()}, accepted boolean, retry_after double")
