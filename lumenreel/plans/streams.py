"""Streams over the events, run to the end of what is there; results are what the same batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.streaming import logs

from .registry import Tables, query


def _folder(t: Tables) -> str:
    """A new folder that all machines share."""
    sc = t.spark.sparkContext
    if sc.getCheckpointDir() is None:
        from lumenreel.tables import shared_checkpoint

        shared_checkpoint(t.spark.range(1))
    return f"{sc.getCheckpointDir()}/stream-{uuid.uuid4()}"


def _events(t: Tables) -> DataFrame:
    # the table is one file or a folder of files
    return logs.source(t.spark, t.folder, t.events.schema, "events.parquet") if not _is_folder(t) else logs.source(t.spark, f"{t.folder}/events.parquet", t.events.schema)


def _is_folder(t: Tables) -> bool:
    p = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.folder}/events.parquet")
    return p.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error'")
def stream_tail(t: Tables) -> DataFrame:
    """New error rows, passed on as they come."""
    rows = logs.tail(_events(t).select("event_id", "user_id", "event_type"), F.col("event_type") == "error")
    return logs.run_all(rows, _folder(t), "tail")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def stream_latest(t: Tables) -> DataFrame:
    rows = logs.run_all(logs.latest(_events(t), "user_id", "ts", ["event_id"]), _folder(t), "latest", "update")
    return logs.last_of(rows, ["user_id"])


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'signup') THEN 'stopped' ELSE 'live' END AS state FROM events GROUP BY ALL")
def stream_liveness(t: Tables) -> DataFrame:
    """Workers by what is known of them at the end of the stream: those that said they stop, and the others."""
    beats = _events(t).select("user_id", F.when(F.col("event_type") == "signup", "stopped").otherwise("live").alias("status"))
    rows = logs.run_all(logs.liveness(beats, "user_id", None), _folder(t), "liveness", "update")
    return logs.last_of(rows, ["user_id"]).select("user_id", "state")


@query("""WITH k AS (SELECT user_id, max(ts) AS last, arg_max(event_type, (ts, event_type = 'signup')) AS kind, (SELECT max(ts) FROM events) AS clock FROM events GROUP BY ALL)
SELECT user_id, CASE WHEN kind = 'signup' THEN 'stopped' WHEN epoch_us(last) // 1000 + 21600000 < epoch_us(clock) // 1000 THEN 'lost' ELSE 'live' END AS state, epoch_us(last) // 1000 AS at FROM k""")
def stream_timeouts(t: Tables) -> DataFrame:
    """Workers at the end of the stream: stopped by their last event, lost if it is over six hours before the latest of all, else live."""
    beats = _events(t).select("user_id", "ts", F.when(F.col("event_type") == "signup", "stopped").otherwise("live").alias("status"))
    rows = logs.run_all(logs.liveness_by_events(beats, "user_id", "ts", 6 * 3600), _folder(t), "timeouts", "update")
    return logs.last_of(rows, ["user_id"]).select("user_id", "state", "at")


@query("""SELECT user_id AS job, epoch_us(max(ts)) AS at, arg_max(event_type, (ts, event_type)) AS state, arg_max(CASE WHEN event_type <> 'view' THEN props END, (ts, props)) FILTER (event_type <> 'view') AS stage, count(*) FILTER (event_type IN ('click', 'error')) AS lines FROM events GROUP BY ALL""")
def stream_records(t: Tables) -> DataFrame:
    """State rows and log lines of jobs out of a stream of changes that is run twice from one checkpoint."""
    e, folder = F.col("event_type"), _folder(t)
    changes = _events(t).select(F.col("user_id").alias("job"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), e.alias("state"), F.when(e != "view", F.col("props")).alias("stage"), F.when(e.isin("click", "error"), F.concat(e, F.lit(" "), F.col("event_id").cast("string"))).alias("message"))
    for _ in range(2):
        logs.record(changes, folder, "records")
    state, log = logs.recorded(t.spark, folder, "records")
    lines = log.groupBy("job").agg(F.count("*").alias("lines"))
    return state.join(lines, "job", "left").select("job", "at", "state", "stage", F.coalesce("lines", F.lit(0).cast("bigint")).alias("lines"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_day_counts(t: Tables) -> DataFrame:
    """Counts by day of event time; all that has come is counted, as the watermark waits longer than the table is late."""
    counts = logs.counts_by_window(_events(t), "ts", "event_type", "1 day", late="60 days")
    rows = logs.run_all(counts, _folder(t), "days", "update")
    return logs.last_of(rows, ["start", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH RECURSIVE e AS (SELECT user_id AS job, row_number() OVER w AS part, count(*) OVER (PARTITION BY user_id) AS total, sum(event_id % 4) OVER w * 0.25 AS sec FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT job, part, sec AS last, true AS passed FROM e WHERE part = 1
  UNION ALL SELECT e.job, e.part, CASE WHEN x THEN sec ELSE r.last END, x FROM r JOIN e ON e.job = r.job AND e.part = r.part + 1, LATERAL (SELECT e.part >= e.total OR e.part % 5 = 0 OR sec - r.last >= 2.0 AS x))
SELECT job, CAST(part AS BIGINT) AS part FROM r WHERE passed""")
def stream_throttle(t: Tables) -> DataFrame:
    """Progress reports of jobs, up to three quarters of a second apart: the first, the last and each fifth pass, and those two seconds after the last that did."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    reports = t.events.select(F.col("user_id").alias("job"), F.row_number().over(w.orderBy("event_id")).alias("part"), F.count("*").over(w).alias("total"), (F.sum(F.col("event_id") % 4).over(w.orderBy("event_id")) * 0.25).alias("at"))
    folder = _folder(t)
    reports.write.parquet(f"{folder}/reports")
    rows = logs.throttle(logs.source(t.spark, f"{folder}/reports", reports.schema, files_at_once=1000), "job")
    return logs.run_all(rows, folder, "throttle").select("job", "part")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 30")
def log_buffer(t: Tables) -> DataFrame:
    return logs.buffer(t.events.select("user_id", "event_id"), "user_id", ["event_id"], 30)
