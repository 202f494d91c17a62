"""Media times in whole milliseconds, and ages against a clock that is given, never read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"(\d{2,}):(\d{2}):(\d{2}),(\d{3})"


def parse_stamp(c: Column) -> Column:
    """Milliseconds (bigint) of HH:MM:SS,mmm; null for anything else."""
    part = lambda k: F.regexp_extract(c, f"^{STAMP}$", k).try_cast("bigint")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def format_stamp(ms: Column) -> Column:
    """HH:MM:SS,mmm; below zero counts as zero, hours may pass 99."""
    v = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    div = lambda a, b: F.floor(a / b).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", div(v, 3_600_000), div(v, 60_000) % 60, div(v, 1000) % 60, v % 1000)


def age_seconds(ts: Column, now: Column) -> Column:
    """Seconds from a time stamp to the clock, 0 at least; null for a time that can't be read."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.try_cast("timestamp"))
    return F.greatest(micros / 1_000_000, F.lit(0.0))


def reading_speed(text: Column, seconds: Column) -> Column:
    """Characters a second, line ends left out."""
    return F.length(F.replace(text, F.lit("\n"), F.lit(""))) / F.greatest(seconds, F.lit(0.01))


#: Tolerance, and the limits of slowing down and speeding up.
SAME, SLOWEST, FASTEST = 0.05, 1.35, 1.15


def retime_plan(source: Column, target: Column) -> Column:
    """(factor, freeze seconds, label): how a clip of so many seconds fills its place."""
    stretch = target / source
    speed = source / target
    plan = lambda factor, freeze, label: F.struct(factor.cast("double").alias("factor"), freeze.cast("double").alias("freeze"), label.alias("label"))
    none = F.lit(None)
    return (
        F.when(F.abs(target - source) <= SAME, plan(none, F.lit(0), F.lit("direct")))
        .when((source < target) & (stretch <= SLOWEST), plan(stretch, F.lit(0), F.format_string("slow_down_%.2fx", stretch)))
        .when(source < target, plan(F.lit(SLOWEST), target - source * SLOWEST, F.lit(f"slow_down_{SLOWEST:.2f}x_plus_freeze")))
        .when(speed <= FASTEST, plan(stretch, F.lit(0), F.format_string("speed_up_%.2fx", speed)))
        .otherwise(plan(none, F.lit(0), F.lit("trim")))
    )


def spread(start: Column, end: Column, count: Column) -> Column:
    """Array of (start, end) of so many equal parts; no time at all becomes 0.18 s a part."""
    stop = F.when(end <= start, start + 0.18 * count).otherwise(end)
    step = (stop - start) / count
    part = lambda k: F.struct((start + step * k).alias("start"), F.when(k == count - 1, stop).otherwise(start + step * (k + 1)).alias("end"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), part)).otherwise(F.array().cast("array<struct<start:double,end:double>>"))
