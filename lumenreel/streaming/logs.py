"""Streams of logs, beats and progress.

The sources are growing folders of files; states are small, by job or worker, and kept in the
checkpoint of the query, which belongs in a folder that all machines share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lumenreel.tables import first_of_key


def source(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.parquet", files_at_once: int = 100) -> DataFrame:
    """Rows of files as they come into a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def tail(logs: DataFrame, where: Column) -> DataFrame:
    """New log rows of interest. The stream's own offsets are the cursor, so a burst of any size is passed on whole."""
    return logs.where(where)


def latest(beats: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The last row of each key so far (update or complete mode); the order by `at` and the columns tells ties apart."""
    row = F.max(F.struct(at, *columns)).alias("_row")
    return beats.groupBy(key).agg(row).select(key, F.col(f"_row.{at}"), *[F.col(f"_row.{c}") for c in columns])


def counts_by_window(rows: DataFrame, at: str, key: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n): counts in windows of event time; rows later than the watermark are left out."""
    timed = rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    w = F.window("_at", size, slide) if slide else F.window("_at", size)
    return timed.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(rows: DataFrame, at: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n): rows of a key with no longer silence than the gap between them."""
    timed = rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def throttle(progress: DataFrame, job: str, every: int = 5, least_seconds: float = 2.0) -> DataFrame:
    """(job, part, total, at) of the reports to pass on: the first and the last part, every fifth, and any that comes two seconds after the one passed on last.

    `progress` has (job, part, total, at in seconds); rows of a job are taken in the order of part.
    """
    kind = dict(progress.dtypes)[job]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        for pdf in parts:
            out = []
            for part, total, at in pdf.sort_values("part")[["part", "total", "at"]].itertuples(index=False):
                if total <= 1 or part <= 1 or part >= total or part % every == 0 or at - last >= least_seconds:
                    out.append((key[0], part, total, at))
                    last = at
            yield pd.DataFrame(out, columns=[job, "part", "total", "at"])
        state.update((float(last),))

    cols = progress.select(job, F.col("part").cast("bigint"), F.col("total").cast("bigint"), F.col("at").cast("double"))
    return cols.groupBy(job).applyInPandasWithState(step, f"{job} {kind}, part bigint, total bigint, at double", "last double", "append", GroupStateTimeout.NoTimeout)


def liveness(beats: DataFrame, worker: str, stale_ms: int | None = 120_000) -> DataFrame:
    """(worker, state): live with each beat, lost once none has come for so long by the clock of the stream; without a limit none is lost, and a run over what is there comes to an end."""
    kind = dict(beats.dtypes)[worker]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "lost")], columns=[worker, "state"])
            return
        stopped = False
        for pdf in parts:
            stopped = stopped or bool((pdf["status"] == "stopped").any())
        if stopped:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], "stopped")], columns=[worker, "state"])
            return
        new = not state.exists
        state.update((1,))
        if stale_ms is not None:
            state.setTimeoutDuration(stale_ms)
        if new:
            yield pd.DataFrame([(key[0], "live")], columns=[worker, "state"])

    return beats.select(worker, "status").groupBy(worker).applyInPandasWithState(step, f"{worker} {kind}, state string", "seen int", "update", GroupStateTimeout.NoTimeout if stale_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def liveness_by_events(beats: DataFrame, worker: str, at: str, stale_seconds: int = 120, late: str = "0 seconds") -> DataFrame:
    """(worker, state, at): live with the first beat, stopped where a beat says so, lost once none has come for so long by the clock of the rows themselves.

    The clock is the watermark, the latest `at` that any worker has sent less `late`: it goes on by what others send, so a run over what is there
    tells the same workers lost whenever it runs. A worker that beats again is live again. `at` of a lost worker is its last beat.
    """
    kind = dict(beats.dtypes)[worker]
    columns = [worker, "state", "at"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "lost", last)], columns=columns)
            return
        beats_, stopped = last or 0, None
        for pdf in parts:
            beats_ = max(beats_, int(pdf["ms"].max()))
            ends = pdf.loc[pdf["status"] == "stopped", "ms"]
            stopped = max(stopped or 0, int(ends.max())) if len(ends) else stopped
        if stopped is not None and stopped >= beats_:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], "stopped", stopped)], columns=columns)
            return
        state.update((beats_,))
        state.setTimeoutTimestamp(max(beats_ + stale_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], "live", beats_)], columns=columns)

    timed = beats.select(worker, "status", F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", late)
    rows = timed.select(worker, "status", "_at", F.unix_millis("_at").alias("ms"))
    return rows.groupBy(worker).applyInPandasWithState(step, f"{worker} {kind}, state string, at bigint", "last bigint", "update", GroupStateTimeout.EventTimeTimeout)


def record(changes: DataFrame, folder: str, name: str) -> None:
    """Run a stream of state changes (job, at, state, stage, message, ...) to its end, with two sinks: state rows and log lines.

    A trigger writes what it changes and what it logs each to a folder of its own number, in place of what may stand there, so a trigger that
    is run again after a failure between the two writes changes nothing. Values that are null leave a job's columns as they are.
    """
    root = f"{folder}/{name}"
    values = [c for c in changes.columns if c not in ("job", "at", "message")]

    def write(rows: DataFrame, n: int) -> None:
        newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", c))).alias(c) for c in values]
        rows.groupBy("job").agg(F.max("at").alias("at"), *newest).write.mode("overwrite").parquet(f"{root}/state/batch={n}")
        rows.where("message is not null").select("job", "at", "stage", "message").write.mode("overwrite").parquet(f"{root}/log/batch={n}")

    query = changes.writeStream.option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def recorded(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(state, log) of what `record` wrote: of each job and column the newest value; all log lines."""
    state, log = (spark.read.parquet(f"{folder}/{name}/{x}") for x in ("state", "log"))
    values = [c for c in state.columns if c not in ("job", "at", "batch")]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "batch", c))).alias(c) for c in values]
    return state.groupBy("job").agg(F.max("at").alias("at"), *newest), log.drop("batch")


def run_all(df: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote; `folder` is shared by all machines.

    With update or complete mode each trigger's rows are kept with its number, so that the last one of a key can be told.
    """
    out, state = f"{folder}/{name}/out", f"{folder}/{name}/state"
    writer = df.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(out)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda rows, n: rows.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    return df.sparkSession.read.parquet(out)


def last_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows that a stream wrote trigger by trigger, the last of each key."""
    return first_of_key(rows, key, [F.desc("_batch")]).drop("_batch", "batch")


def buffer(logs: DataFrame, job: str, order: list[str], most: int = 300) -> DataFrame:
    """The newest rows of each job."""
    return first_of_key(logs, [job], [F.desc(c) for c in order], most)
