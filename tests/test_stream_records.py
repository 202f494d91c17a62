"""Streams that write to two places, and workers that time out by the rows' own clock."""

import pytest
from pyspark.sql import functions as F

from lumenreel.streaming import logs

CHANGES = "job string, at bigint, state string, done bigint, stage string, message string"


def feed(spark, folder, rows, schema=CHANGES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_a_trigger_that_is_run_again_changes_nothing(spark, tmp_path, monkeypatch):
    source, out = f"{tmp_path}/in", str(tmp_path)
    feed(spark, source, [("a", 1, "running", None, "probe", "begun"), ("a", 2, None, 1, None, None), ("b", 1, "queued", None, None, None)])
    logs.record(logs.source(spark, source, CHANGES), out, "jobs")
    feed(spark, source, [("a", 3, None, 2, "render", "second"), ("b", 2, "failed", None, "probe", "lost")])
    # the second trigger fails after its first write
    calls = []

    def breaks(self, path, *args, **kwargs):
        calls.append(path)
        if "/log/" in path:
            raise OSError("no space")
        return written(self, path, *args, **kwargs)

    from pyspark.sql.readwriter import DataFrameWriter

    written = DataFrameWriter.parquet
    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", breaks)
        with pytest.raises(Exception, match="no space"):
            logs.record(logs.source(spark, source, CHANGES), out, "jobs")
    assert any("batch=1" in c for c in calls)
    for _ in range(2):
        logs.record(logs.source(spark, source, CHANGES), out, "jobs")
    state, log = logs.recorded(spark, out, "jobs")
    assert sorted(map(tuple, state.select("job", "at", "state", "done", "stage").collect())) == [("a", 3, "running", 2, "render"), ("b", 2, "failed", None, "probe")]
    assert sorted(map(tuple, log.select("job", "at", "stage", "message").collect())) == [("a", 1, "probe", "begun"), ("a", 3, "render", "second"), ("b", 2, "probe", "lost")]


def test_workers_time_out_and_come_back(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/run"
    beats = "worker string, at timestamp, status string"

    def send(*rows):
        frame = spark.createDataFrame(rows, "worker string, s int, status string")
        frame.select("worker", F.timestamp_seconds(F.col("s") + 1000).alias("at"), "status").coalesce(1).write.mode("append").parquet(source)

    seen = []
    for rows in ([("x", 0, "up"), ("y", 0, "up")], [("y", 100, "up")], [("y", 200, "up"), ("z", 190, "stopped")], [("x", 210, "up")], [("y", 400, "up")]):
        send(*rows)
        got = logs.run_all(logs.liveness_by_events(logs.source(spark, source, beats), "worker", "at", 120), out, "beats", "update")
        seen = sorted((r["_batch"], r["worker"], r["state"], r["at"] // 1000 - 1000) for r in got.collect())
    states = [(w, s, a) for _, w, s, a in seen]
    assert [s for s in states if s[0] == "x"] == [("x", "live", 0), ("x", "lost", 0), ("x", "live", 210), ("x", "lost", 210)]
    # y's own late beat does not wait for the clock that it moves
    assert [s for s in states if s[0] == "y"] == [("y", "live", s) for s in (0, 100, 200, 400)]
    assert ("z", "stopped", 190) in states
