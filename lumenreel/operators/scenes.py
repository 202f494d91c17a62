"""Scenes: rows (document, position, start_ms, end_ms, text, ...) on the line of media time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.tables import first_of_key, places, running, scan

# Fixed values, in milliseconds: tolerances, and lengths of scenes.
OVERLAP_ERROR, OVERLAP_REPAIR, COVERAGE, DURATION_OFF, GAP_WARNING, SNAP = 50, 250, 3000, 350, 500, 500
LONGEST, TARGET, SHORTEST, LEAST = 18_000, 14_000, 4_000, 1_000
KINDS = ("image", "video")


def is_placeholder(start: Column, end: Column, duration: Column, text: Column, notes: Column) -> Column:
    """A row that only marks a gap: no text, no length, and a note that says so."""
    says = F.lower(F.coalesce(notes, F.lit("")))
    return (T.collapse(F.coalesce(text, F.lit(""))) == "") & ~((end > start) & (duration > 0)) & (says.contains("skip") | says.contains("gap") | says.contains("absorbed"))


def clean(df: DataFrame, key: list[str], position: str, seconds: bool = True) -> DataFrame:
    """Rows of a model's answer (start, end, duration, text, notes) with times in milliseconds and an `error`.

    Gap marks are left out. Where all rows from one on are gap marks, without length or without text,
    that tail is left out too; any other row that has no length, no text or no numbers has an error.
    """
    ms = lambda c: F.round(F.col(c).try_cast("double") * (1000 if seconds else 1)).cast("bigint")
    rows = df.withColumns({"start_ms": ms("start"), "end_ms": ms("end"), "text": T.collapse(F.coalesce("text", F.lit(""))), "notes": F.coalesce("notes", F.lit(""))})
    rows = rows.withColumn("duration_ms", F.coalesce(ms("duration"), F.col("end_ms") - F.col("start_ms")))
    mark = F.coalesce(is_placeholder(F.col("start_ms"), F.col("end_ms"), F.col("duration_ms"), F.col("text"), F.col("notes")), F.lit(False))
    known = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    weak = known & (mark | (F.col("end_ms") <= F.col("start_ms")) | (F.col("text") == ""))
    rest = Window.partitionBy(*key).orderBy(position).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns({"_mark": mark, "_tail": F.min(weak.cast("int")).over(rest) == 1})
    error = (
        F.when(~known, F.lit("Invalid numeric field."))
        .when(F.col("end_ms") <= F.col("start_ms"), F.lit("Scene ends before it starts."))
        .when(F.col("text") == "", F.lit("Scene has no text."))
    )
    off = F.abs(F.col("end_ms") - F.col("start_ms") - F.col("duration_ms")) > DURATION_OFF
    return rows.where("not _mark and not _tail").withColumns({"error": error, "warning": F.when(off, F.lit("Scene duration does not match start/end."))}).drop("_mark", "_tail", "start", "end", "duration")


def rebase(scenes: DataFrame, chunks: DataFrame, chunk: str) -> DataFrame:
    """Scenes whose times count from their chunk's start are moved to it.

    `chunks` has (chunk, from_ms, to_ms). A chunk is moved if it starts after the first second, its
    first scene lies over five seconds before it, and its last one ends no more than three seconds
    after the chunk's length.
    """
    own = Window.partitionBy(chunk)
    met = scenes.join(chunks.select(chunk, F.col("from_ms").alias("_from"), F.col("to_ms").alias("_to")), chunk, "left")
    rows = met.withColumns({"_low": F.min("start_ms").over(own), "_high": F.max("end_ms").over(own)})
    move = (F.col("_from") > 1000) & (F.col("_to") > F.col("_from")) & (F.col("_low") < F.col("_from") - 5000) & (F.col("_high") <= F.col("_to") - F.col("_from") + 3000)
    out = rows.withColumn("_by", F.when(move, F.col("_from")).otherwise(F.lit(0)))
    return out.withColumns({"start_ms": F.col("start_ms") + F.col("_by"), "end_ms": F.col("end_ms") + F.col("_by"), "rebased": F.col("_by") > 0}).drop("_by", "_from", "_to", "_low", "_high")


def owned(scenes: DataFrame, windows: DataFrame, document: str, chunk: str, overlap_ms: int) -> DataFrame:
    """The scenes that each chunk keeps of those it shares with its neighbours.

    `windows` has (document, chunk, from_ms, to_ms). Half the overlap goes off at inner ends; scenes
    with their middle in what is left, ends included, stay. A chunk without any keeps the one whose
    middle is nearest to its own, the earlier one of two.
    """
    edges = windows.groupBy(document).agg(F.min(chunk).alias("_first"), F.max(chunk).alias("_last"))
    half = overlap_ms / 2
    w = windows.join(edges, document)
    low = F.col("from_ms") + F.when(F.col(chunk) > F.col("_first"), F.lit(half)).otherwise(0.0)
    high = F.col("to_ms") - F.when(F.col(chunk) < F.col("_last"), F.lit(half)).otherwise(0.0)
    w = w.select(document, chunk, F.when(high <= low, F.col("from_ms").cast("double")).otherwise(low).alias("_low"), F.when(high <= low, F.col("to_ms").cast("double")).otherwise(high).alias("_high"))
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    rows = scenes.join(w, [document, chunk]).withColumns({"_in": mid.between(F.col("_low"), F.col("_high")), "_far": F.abs(mid - (F.col("_low") + F.col("_high")) / 2)})
    best = rows.groupBy(document, chunk).agg(F.max("_in").alias("_any"), F.min(F.struct("_far", "start_ms", "end_ms")).alias("_best"))
    nearest = F.struct("_far", "start_ms", "end_ms") == F.col("_best")
    return rows.join(best, [document, chunk]).where(F.col("_in") | (~F.col("_any") & nearest)).drop("_low", "_high", "_in", "_far", "_any", "_best")


def dedupe(scenes: DataFrame, document: str, tie: list[str]) -> DataFrame:
    """The first scene of those with the same text, start and end to a tenth of a second."""
    tenth = lambda c: F.bround(F.col(c) / 100).cast("bigint")
    rows = scenes.withColumns({"_s": tenth("start_ms"), "_e": tenth("end_ms"), "_t": T.compare_form(F.col("text"))})
    order = [F.col("start_ms"), F.col("end_ms"), *[F.col(c) for c in tie]]
    return first_of_key(rows, [document, "_s", "_e", "_t"], order).drop("_s", "_e", "_t")


def numbered(scenes: DataFrame, document: str, order: list[str], leading_videos: int = 20) -> DataFrame:
    """`scenes` with n, scene_id (scene_001, ...) and asset_type: the first ones are videos, the rest images."""
    out = running(scenes, [document], order)
    return out.withColumns({"scene_id": F.format_string("scene_%03d", F.col("n")), "asset_type": F.when(F.col("n") <= leading_videos, F.lit("video")).otherwise(F.lit("image"))})


def checks(scenes: DataFrame, document: str, order: list[str], tolerance: int = OVERLAP_ERROR, gap: int = GAP_WARNING) -> DataFrame:
    """`scenes` with the columns prev_end_ms, codes and warnings (arrays): each scene against itself and the one before it."""
    w = Window.partitionBy(document).orderBy(*order)
    rows = scenes.withColumn("prev_end_ms", F.lag("end_ms").over(w))
    length = F.col("end_ms") - F.col("start_ms")
    said = F.coalesce(F.col("duration_ms"), length) if "duration_ms" in scenes.columns else length
    kind = (F.col("asset_type").isNull() | ~F.col("asset_type").isin(*KINDS)) if "asset_type" in scenes.columns else F.lit(False)
    prev = F.col("prev_end_ms")
    pick = lambda *cases: F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in cases]), lambda x: x.isNotNull())
    errors = pick(("ends_before_start", length <= 0), ("duration_mismatch", F.abs(length - said) > DURATION_OFF), ("bad_type", kind), ("overlap", F.col("start_ms") < prev - tolerance))
    away = F.col("start_ms") - prev
    warnings = pick(("very_short", said < LEAST), ("very_long", said > LONGEST), ("gap", away > gap), ("small_gap", (away > tolerance) & (away <= gap)))
    return rows.withColumns({"codes": errors, "warnings": warnings})


def report(checked: DataFrame, document: str, position: str, cues: DataFrame | None = None) -> DataFrame:
    """A row for each document of `checks`: counts, status, total length, and how far the cues reach beyond its ends."""
    out = checked.groupBy(document).agg(
        F.count("*").alias("scenes"), F.sum(F.size("codes")).alias("errors"), F.sum(F.size("warnings")).alias("warnings"),
        F.min_by("start_ms", position).alias("start_ms"), F.max_by("end_ms", position).alias("end_ms"),
    )
    head = tail = F.lit(0).cast("bigint")
    if cues is not None:
        span = cues.groupBy(document).agg(F.min("start_ms").alias("_from"), F.max("end_ms").alias("_to"))
        out = out.join(span, document, "left")
        head, tail = F.coalesce(F.col("start_ms") - F.col("_from"), head), F.coalesce(F.col("_to") - F.col("end_ms"), tail)
    out = out.withColumns({"head_gap_ms": head, "tail_gap_ms": tail})
    bad = F.col("errors") + (F.col("head_gap_ms") > COVERAGE).cast("int") + (F.col("tail_gap_ms") > COVERAGE).cast("int")
    return out.select(document, "scenes", bad.alias("errors"), "warnings", F.when(bad == 0, F.lit("valid")).otherwise(F.lit("invalid")).alias("status"), (F.col("end_ms") - F.col("start_ms")).alias("total_ms"), "head_gap_ms", "tail_gap_ms")


def repair_overlaps(scenes: DataFrame, document: str, order: list[str], most: int = OVERLAP_REPAIR) -> DataFrame:
    """Scenes that begin slightly before the one before them ends begin there; `repaired` marks them. Ends stay, so the rows before suffice."""
    w = Window.partitionBy(document).orderBy(*order)
    rows = scenes.withColumn("_prev", F.lag("end_ms").over(w))
    hit = F.coalesce((F.col("_prev") - F.col("start_ms")).between(1, most), F.lit(False))
    return rows.withColumns({"repaired": hit, "start_ms": F.when(hit, F.col("_prev")).otherwise(F.col("start_ms"))}).drop("_prev")


def snap(df: DataFrame, boundaries: DataFrame, document: str, time: str, tolerance: int = SNAP) -> DataFrame:
    """`df` with `snapped`: the nearest boundary (document, at_ms) within the tolerance, the lower one of two, else the time itself.

    Each time looks into the buckets that the tolerance reaches, so it is an equality join on
    document and bucket, and a long document spreads over many tasks.
    """
    size = max(1, tolerance)
    marks = boundaries.select(document, F.col("at_ms")).distinct().withColumn("_bucket", F.floor(F.col("at_ms") / size))
    times = df.select(document, time).distinct()
    near = times.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col(time) - size) / size), F.floor((F.col(time) + size) / size))))
    found = near.join(marks, [document, "_bucket"]).where(F.abs(F.col("at_ms") - F.col(time)) <= tolerance)
    best = found.groupBy(document, time).agg(F.min(F.struct(F.abs(F.col("at_ms") - F.col(time)).alias("far"), F.col("at_ms").alias("at"))).alias("_best"))
    return df.join(best, [document, time], "left").withColumn("snapped", F.coalesce(F.col("_best.at"), F.col(time))).drop("_best")


def clamp(df: DataFrame, document: str, position: str, least: int = LEAST) -> DataFrame:
    """(document, position, start_ms, end_ms) of mapped scenes: no scene begins before the last one ends or is shorter than `least`; the last ends with the document (total_ms)."""
    kinds = dict(df.dtypes)

    def start():
        return {"end": None, "held": None}

    def step(state, row):
        out = []
        if state["held"] is not None:
            d, p, s, e, total = state["held"]
            out = [(d, p, s, total if row is None else e)]
        if row is not None:
            begin = row["start_ms"] if state["end"] is None else max(row["start_ms"], state["end"])
            end = max(row["end_ms"], begin + least)
            state["end"], state["held"] = end, (row[document], row[position], begin, end, row["total_ms"])
        return out

    cols = df.select(document, position, "start_ms", "end_ms", "total_ms")
    return scan(cols, [document], [position], start, step, f"{document} {kinds[document]}, {position} {kinds[position]}, start_ms bigint, end_ms bigint")


def split_long(scenes: DataFrame, cues: DataFrame, document: str, scene: str, longest: int = LONGEST, target: int = TARGET, shortest: int = SHORTEST) -> DataFrame:
    """(document, scene, part, start_ms, end_ms): scenes over the limit, cut at ends of cues.

    Each part takes cues while it is no longer than `longest` and ends at the cue that comes nearest
    to `target`; an end without punctuation counts three quarters of a second worse, ends before
    `shortest` do not count unless they are the last. Scenes of fewer than two cues stay whole.
    """
    from .cues import overlap_join

    kinds = dict(scenes.dtypes)
    long = scenes.where(F.col("end_ms") - F.col("start_ms") > longest).select(document, scene, "start_ms", "end_ms")
    stop = F.regexp_like(F.col("text"), F.lit(r"[.!?:;]\s*$"))
    inside = overlap_join(long, cues.select(document, "start_ms", "end_ms", stop.alias("stop")), document, longest).select(document, scene, "r_start_ms", "r_end_ms", "r_stop")

    def start():
        return {"cues": [], "part": 0}

    def cut(state, last: bool):
        """Parts that no later cue can change."""
        out, held = [], state["cues"]
        while held:
            begin = held[0][2]
            fits = 1
            while fits < len(held) and held[fits][3] - begin <= longest:
                fits += 1
            if fits == len(held) and not last:
                break
            ends = [k for k in range(fits) if held[k][3] - begin >= shortest or k == fits - 1]
            k = min(ends, key=lambda k: abs(target - (held[k][3] - begin)) + (0 if held[k][4] else 750))
            out.append((held[0][0], held[0][1], state["part"], begin, held[k][3]))
            state["part"] += 1
            del held[: k + 1]
        return out

    def step(state, row):
        if row is None:
            return cut(state, True)
        state["cues"].append((row[document], row[scene], row["r_start_ms"], row["r_end_ms"], row["r_stop"]))
        return cut(state, False)

    kind = f"{document} {kinds[document]}, {scene} {kinds[scene]}, part bigint, start_ms bigint, end_ms bigint"
    enough = inside.groupBy(document, scene).count().where("count >= 2").drop("count")
    parts = scan(inside.join(enough, [document, scene]), [document, scene], ["r_start_ms", "r_end_ms"], start, step, kind)
    whole = scenes.select(document, scene, F.lit(0).cast("bigint").alias("part"), "start_ms", "end_ms").join(enough, [document, scene], "left_anti")
    return parts.unionByName(whole)


def zipped(groups: DataFrame, metadata: DataFrame, key: str, position: str) -> DataFrame:
    """Groups of scenes (key, position, ...) with the chunk metadata at the same position of their document, where both have equally many; else with nulls.

    Positions count from 0 by themselves on both sides, whatever gaps they have.
    """
    extra = [c for c in metadata.columns if c not in (key, position)]
    found = places(metadata, key, position, "_place", "_n").select(key, "_place", "_n", *extra)
    return places(groups, key, position, "_place", "_n").join(found, [key, "_place", "_n"], "left").select(*groups.columns, *extra)


def with_prompts(scenes: DataFrame, sources: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """`scenes` (key, asset_type) that have a prompt: of sources (key, prompt) for one asset type each, later ones come first; a source counts only where its type occurs."""
    rows = None
    for n, (df, kind) in enumerate(sources):
        part = df.select(key, "prompt", F.lit(n).alias("_n"), F.lit(kind).alias("asset_type"))
        rows = part if rows is None else rows.unionAll(part)
    rows = rows.join(scenes.select("asset_type").distinct(), "asset_type", "left_semi")
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("prompt", F.struct("_n", "prompt")).alias("prompt"))
    return scenes.join(best, key)
