"""Live views of jobs with Structured Streaming: progress, latest state, fan-out, limits, repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.jobs import parse_log, retention_filter

#: Milliseconds that a key's state outlives its last event.
IDLE_MS = 7_200_000


def _millis(ts: pd.Series) -> int:
    return int(ts.max().timestamp() * 1000)


def stream_progress(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """(job_id, percent, page, lines): the last stage by ``seq`` and the largest page so far; update mode.

    ``lines``: job_id, seq, line, ts. A job is forgotten when event time is two
    hours past its last line, and lines later than the watermark are dropped.
    """

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, percent, page, n, newest = state.get if state.exists else (-1, 0, 0, 0, 0)
        for pdf in batches:
            n, newest = n + len(pdf), max(newest, _millis(pdf["ts"]))
            staged, pages = pdf[pdf["percent"].notna()], pdf["page"].dropna()
            if len(staged) and (last := staged.loc[staged["seq"].idxmax()])["seq"] >= at:
                at, percent = int(last["seq"]), int(last["percent"])
            page = max(page, int(pages.max())) if len(pages) else page
        state.update((at, percent, page, n, newest))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + IDLE_MS)
        yield pd.DataFrame({"job_id": [key[0]], "percent": [percent], "page": [page], "lines": [n]})

    rows = parse_log(lines).withWatermark("ts", late).select("job_id", "seq", "percent", "page", "ts")
    state = "at long, percent int, page int, n long, newest long"
    return rows.groupBy("job_id").applyInPandasWithState(work, "job_id long, percent int, page int, lines long", state, "update", GroupStateTimeout.EventTimeTimeout)


def stream_tail(lines: DataFrame, last: int = 200, late: str = "1 hour") -> DataFrame:
    """(job_id, tail): the last lines of each job after every batch that brings new ones; update mode.

    A job's lines are forgotten when event time is two hours past its last one.
    """

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = {(int(x[:20]), x[21:]) for x in state.get[0]} if state.exists else set()
        newest = 0
        for pdf in batches:
            newest = max(newest, _millis(pdf["ts"]))
            kept |= set(zip(pdf["seq"].astype(int), pdf["line"], strict=True))
        kept = sorted(kept)[-last:]
        state.update(([f"{s:020d} {x}" for s, x in kept],))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + IDLE_MS)
        yield pd.DataFrame({"job_id": [key[0]], "tail": ["\n".join(x for _, x in kept)]})

    return lines.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(work, "job_id long, tail string", "kept array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def stream_latest(messages: DataFrame, key: str = "id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The newest message of each key, whenever a newer one comes; update mode.

    A key's state is the time and text of its newest message; it is forgotten
    when event time is two hours past it. Of messages of one time the one with
    the largest text as JSON counts, in whatever order they come; those without a
    time go.
    """
    rest = [c for c in messages.columns if c != key]
    body = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
    rows = messages.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(key), F.col(ts).alias("__ts"), F.to_json(F.struct(*rest), body).alias("__body"))
    kind = messages.schema[key].dataType.simpleString()

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = tuple(state.get) if state.exists else (-1, "")
        new = old
        for pdf in batches:
            newest = pdf["__ts"].max()
            new = max(new, (newest.value // 1000, pdf.loc[pdf["__ts"] == newest, "__body"].max()))
        state.update(new)
        state.setTimeoutTimestamp(max(new[0] // 1000, state.getCurrentWatermarkMs()) + IDLE_MS)
        if new != old:
            yield pd.DataFrame({key: [k[0]], "__body": [new[1]]})

    out = rows.groupBy(key).applyInPandasWithState(work, f"`{key}` {kind}, __body string", "at long, body string", "update", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.from_json("__body", messages.select(*rest).schema, body).alias("m")).select(key, "m.*")


def stream_fanout(messages: DataFrame, jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Messages with each user who may see them: the job's owner and all admins. ``jobs`` and ``users`` are static.

    A message goes to two audiences, its owner's and the admins'; users belong
    to their own and perhaps to the admins', so both meet on an equal key.
    """
    name = lambda c: F.concat(F.lit("user "), F.col(c).cast("string"))
    owned = messages.join(jobs.select(F.col("id").alias("job_id"), "owner_id"), "job_id")
    sent = owned.withColumn("audience", F.explode(F.array(name("owner_id"), F.lit("admins"))))
    own = users.select("user_id", name("user_id").alias("audience"))
    members = own.union(users.where("is_admin").select("user_id", F.lit("admins").alias("audience")))
    twice = (F.col("audience") == "admins") & (F.col("user_id") == F.col("owner_id"))
    return sent.join(members, "audience").where(~twice).select(*messages.columns, "user_id")


def stream_ratelimit(events: DataFrame, limit: int, window_s: float = 60, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """(key, event_id, accepted, retry_after): a sliding limit over accepted events; append mode.

    The state of a key is the times of its accepted events within the window;
    events of a batch are taken in order of time, and late ones after those
    already seen.
    """

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts in zip(pdf["event_id"], pdf["ts"], strict=True):
            t = ts.timestamp()
            kept = [x for x in kept if x > t - window_s]
            ok = len(kept) < limit
            out.append((k[0], event_id, ok, 0.0 if ok else kept[0] + window_s - t))
            if ok:
                kept.append(t)
        state.update((kept,))
        state.setTimeoutTimestamp(max(_millis(pdf["ts"]), state.getCurrentWatermarkMs()) + IDLE_MS)
        yield pd.DataFrame(out, columns=[key, "event_id", "accepted", "retry_after"])

    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(work, f"{key} long, event_id long, accepted boolean, retry_after double", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_quota(changes: DataFrame, limit: int, late: str = "1 hour") -> DataFrame:
    """(owner_id, active, admitted) from status changes (owner_id, job_id, seq, status, ts); update mode.

    The state of an owner is the last change of each job by ``seq``: a change that
    comes again, or after a later one, counts for nothing. Jobs at their end are
    forgotten when the watermark is two hours past their last change (older
    changes are dropped as late by then), owners with their last job; jobs that
    wait or run stay.
    """

    def kept(jobs: dict, watermark: int) -> dict:
        return {j: x for j, x in jobs.items() if x[1] or x[2] + IDLE_MS >= watermark}

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, seqs, active, times = state.get if state.exists else ([], [], [], [])
        jobs = {j: (s, a, t) for j, s, a, t in zip(ids, seqs, active, times, strict=True)}
        watermark = state.getCurrentWatermarkMs()
        fresh = not state.hasTimedOut
        if fresh:
            for pdf in batches:
                for job, seq, status, ts in zip(pdf["job_id"], pdf["seq"], pdf["status"], pdf["ts"], strict=True):
                    if job not in jobs or seq > jobs[job][0]:
                        jobs[job] = (int(seq), status in ("queued", "running"), int(ts.timestamp() * 1000))
        jobs = kept(jobs, watermark)
        if jobs:
            state.update((list(jobs), *([x[k] for x in jobs.values()] for k in range(3))))
            state.setTimeoutTimestamp(max(watermark, *(x[2] for x in jobs.values())) + IDLE_MS + 1)
        elif state.exists:
            state.remove()
        if fresh:
            n = sum(x[1] for x in jobs.values())
            yield pd.DataFrame({"owner_id": [key[0]], "active": [n], "admitted": [n < limit]})

    state = "jobs array<long>, seqs array<long>, active array<boolean>, times array<long>"
    return changes.withWatermark("ts", late).groupBy("owner_id").applyInPandasWithState(work, "owner_id long, active long, admitted boolean", state, "update", GroupStateTimeout.EventTimeTimeout)


def sweep_batch(read_jobs: Callable[[], DataFrame], ledger: str, days: int) -> Callable[[DataFrame, int], None]:
    """A sink of ticks (ts): each batch adds the jobs that are now too old to the ledger (id, batch), each job once.

    A batch writes its own part of the ledger, and only earlier parts count as
    swept, so a batch that runs again after a failure gives the same part.
    """

    def sweep(ticks: DataFrame, batch: int) -> None:
        now = ticks.agg(F.max("ts")).first()[0]
        if now is None:
            return
        old = retention_filter(read_jobs(), F.lit(now).cast("timestamp"), days).select("id").distinct()
        spark = ticks.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            before = spark.read.schema(old.schema.add("batch", "long")).parquet(ledger).where(F.col("batch") < batch)
            old = old.join(before, "id", "left_anti")
        old.write.mode("overwrite").parquet(f"{ledger.rstrip('/')}/batch={batch}")

    return sweep


def stream_retention(ticks: DataFrame, read_jobs: Callable[[], DataFrame], ledger: str, checkpoint: str, days: int) -> DataStreamWriter:
    """The sweep of finished jobs older than ``days``, a run over all ticks that have come; the ledger says what to delete."""
    return ticks.writeStream.foreachBatch(sweep_batch(read_jobs, ledger, days)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_template(lines: DataFrame, least: int = 2, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Running repeat counts of texts in windows of event time: (start, text, pages); update mode.

    Approximate (a sketch of the pages is all the state of a text), the batch
    operator decides. A window's texts are forgotten when the watermark passes
    its end. Frequent texts are counted on the map side first.
    """
    rows = lines.withColumn("text", F.trim("text")).where("text != ''").withWatermark("ts", late)
    counted = rows.groupBy(F.window("ts", every).alias("w"), "text").agg(F.approx_count_distinct("page_id").alias("pages"))
    return counted.where(F.col("pages") >= least).select(F.col("w.start").alias("start"), "text", "pages")


def windowed_counts(events: DataFrame, every: str = "10 minutes", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """Events by kind in tumbling or sliding windows of event time, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by gaps of event time, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
