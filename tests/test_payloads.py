"""Cases of guides, prompts, timelines and waiting episodes; gap sweeps against a plain loop."""

import json
import re

from pyspark.sql import functions as F

from lumenreel import catalog
from lumenreel.operators import payloads


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_guide(spark):
    empty = one(spark, None, payloads.guide)
    assert (empty["status"], len(empty["errors"]), empty["character_count"], len(empty["warnings"])) == ("invalid", 8, 0, 1)
    assert one(spark, "no json", payloads.guide) == empty
    world = {k: f" {k}\n x" for k in payloads.WORLD}
    got = one(spark, json.dumps({"world_style": world, "characters": [None, {"label": "A", "visual_description": "b", "other": 1}], "continuity_rules": ["", "one  two"], "environment_rules": "x\ny"}), payloads.guide)
    assert got["status"] == "valid" and got["world_style"]["look"] == "look x"
    assert [c["character_id"] for c in got["characters"]] == ["character_002"]
    assert (got["continuity_rules"], got["environment_rules"]) == (["one two"], ["x", "y"])


def test_prompts_without_an_entry_are_left_out(spark):
    scenes = spark.createDataFrame([(1, 0, "a", "image"), (1, 1, "b", "image"), (2, 0, "c", "video")], "k int, place int, scene_id string, asset_type string")
    fields = ", ".join(f"{c} string" for c in ("scene_id", "prompt", *payloads.PROMPT_FIELDS))
    entries = spark.createDataFrame([(1, 0, None, None, *[None] * 8)], f"k int, place int, {fields}")
    pairs = payloads.paired_prompts(scenes, entries, "k", "place", ("no text",))
    assert [tuple(r) for r in pairs.collect()] == [(1, 0, "a", "image", "", ["Prompt 1: Prompt is empty."], [])]
    report = {r["k"]: (r["status"], r["n_errors"], r["scene_count"], r["prompt_count"]) for r in payloads.prompt_report(scenes, entries, pairs, "k").collect()}
    assert report == {1: ("invalid", 2, 2, 1), 2: ("invalid", 1, 1, 0)}


def test_subject_with_marks_and_cases(spark):
    person = lambda *aliases: F.array(F.struct(F.lit("D").alias("display_name"), F.array(*map(F.lit, aliases)).alias("aliases"), F.lit("tall $1").alias("descriptor")))
    assert one(spark, "see j.r. and J.R. run", lambda c: payloads.expand_subject(c, person("J.R", "x"))) == "see j.r (tall $1). and J.R. run"
    assert one(spark, "Élan jxr", lambda c: payloads.expand_subject(c, person("J.R"))) == "D (tall $1), élan jxr"
    assert one(spark, None, lambda c: payloads.expand_subject(c, person("x"))) == "D (tall $1)"


def test_timeline(spark):
    files = F.create_map(F.lit("a"), F.lit("assets/a.mp4"))
    scene = {"scene_id": "a", "start": 0, "end": 1, "duration": 1, "motion": {"enabled": True}}
    got = one(spark, json.dumps([scene, {**scene, "scene_id": "b", "asset_id": "own"}]), lambda c: payloads.timeline(c, files))
    assert [(s["asset_id"], s["asset_file"], s["asset_type"], s["motion"]["enabled"], s["motion"]["mode"]) for s in got["scenes"]] == [("asset_001", "assets/a.mp4", "video", True, "static"), ("own", "assets/blank.png", "image", True, "static")]
    assert (got["fps"], got["width"], got["errors"]) == (30, 1920, [])
    assert len(one(spark, "broken", payloads.timeline)["errors"]) == 6
    assert len(one(spark, None, payloads.timeline)["errors"]) == 6


def test_paused_action_without_rows_elsewhere(spark):
    e = spark.createDataFrame([(1, False), (2, True)], "e int, pause_requested boolean")
    none = spark.createDataFrame([], "e int")
    statuses = spark.createDataFrame([(1, "done"), (2, "done")], "e int, tts_status string")
    queue = spark.createDataFrame([], "e int, active_jobs int, submitted_jobs int, blocked boolean")
    got = payloads.paused_actions(e, none, none, statuses, queue, "e").collect()
    assert {tuple(r) for r in got} == {(1, "resume_at_alignment"), (2, "pause_at_alignment")}


def test_gap_sweeps_against_a_plain_loop(spark, sf):
    got = [r.asDict() for r in catalog.QUERIES["swept_gaps"](spark, sf).collect()]
    assert any(r["end"] != r["raw_end"] for r in got)
    from lumenreel.operators import segmentation

    start = F.col("raw_start")
    before = spark.createDataFrame(got).select("l_orderkey", "segment", start.alias("start"), F.col("raw_end").alias("end"), "chars", "raw_start", "raw_end")
    docs = {}
    for r in segmentation.share_gaps(before, "l_orderkey").collect():
        docs.setdefault(r["l_orderkey"], []).append(r.asDict())

    def tiers(cs, ds):
        v = [c / max(d, 0.01) for c, d in zip(cs, ds, strict=True)]
        return [sum(x > t for x in v) for t in (18, 24, 30)] + [max(v), sum(max(0, x - 18) for x in v)]

    moved = 0
    for rows in docs.values():
        rows.sort(key=lambda r: r["segment"])
        for _ in range(2):
            for a, b in zip(rows, rows[1:], strict=False):
                gap = b["raw_start"] - a["raw_end"]
                if gap <= 0:
                    continue
                left, right = max(0, a["end"] - a["raw_end"]), max(0, b["raw_start"] - b["start"])
                da, db = max(0.01, a["end"] - a["start"] - left), max(0.01, b["end"] - b["start"] - right)
                total = min(gap, 1.5) if gap > 0.75 else gap
                cap = min(0.75, gap)
                best, pair, x = tiers((a["chars"], b["chars"]), (da + left, db + right)), None, max(0, total - cap)
                tries = {round(left, 3), round(x, 3), round(min(cap, total), 3)}
                while x <= min(cap, total) + 1e-9:
                    tries.add(round(x, 3))
                    x += 0.05
                for s in sorted(tries):
                    rest = max(0, min(cap, total - s))
                    if s < max(0, total - cap) - 1e-9:
                        continue
                    cost = tiers((a["chars"], b["chars"]), (da + s, db + rest))
                    if cost < best:
                        best, pair = cost, (s, rest)
                if pair:
                    moved += 1
                    a["end"], b["start"] = a["raw_end"] + pair[0], b["raw_start"] - pair[1]
    assert moved
    want = {(r["l_orderkey"], r["segment"]): (r["start"], r["end"]) for rows in docs.values() for r in rows}
    off = [r for r in got if max(abs(x - y) for x, y in zip(want[r["l_orderkey"], r["segment"]], (r["start"], r["end"]), strict=True)) > 1e-6]
    assert not off and len(want) == len(got)


def test_previews_without_a_path_are_dealt_out(spark):
    """Rows without a path, a third of them or all, are not partitioned by their path alone: that is one task."""
    statuses = spark.createDataFrame([(1, "de", None, "done", None), (1, "fr", "a", None, " e "), (2, "de", "b", None, ""), (3, "de", "c", None, None)], "e int, l string, script_path string, translation_status string, error_message string")
    episodes = spark.createDataFrame([(1, "one"), (2, None), (3, "three")], "e int, script_text string")
    files = spark.createDataFrame([("a", "A"), ("b", ""), (None, "nowhere")], "path string, content string")
    reports = spark.createDataFrame([(1, "de", " said ", None), (2, "de", "x", "y")], "e int, l string, translated_script string, error_message string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = payloads.translation_preview(statuses, episodes, files, reports, "e", "l")
        assert not re.search(r"hashpartitioning\(script_path#\d+, \d+\)", out._jdf.queryExecution().executedPlan().toString())
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(1, "de", "one", "said", "done", ""), (1, "fr", "one", "A", "pending", "e"), (2, "de", "", "x", "pending", "y"), (3, "de", "three", "", "pending", "")]


def test_sweeps_follow_each_other_in_one_pass(spark):
    """Segments are dealt, sorted and handed to Python once, however many sweeps there are; documents of one segment and of several."""
    from lumenreel.operators import segmentation

    rows = [("a", k, 3.0 * k, 3.0 * k + 1 + k % 2, 20 + 17 * (k % 4)) for k in range(6)] + [("b", 0, 1.0, 2.0, 90)]
    df = segmentation.share_gaps(spark.createDataFrame(rows, "doc string, segment int, raw_start double, raw_end double, chars int").selectExpr("*", "raw_start AS start", "raw_end AS end"), "doc")
    got = segmentation.sweep_gaps(df, "doc")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    want = {d: [r.asDict() for r in sorted(df.where(f"doc = '{d}'").collect(), key=lambda r: r.segment)] for d in "ab"}
    for rs in want.values():
        for _ in range(2):
            for left, right in zip(rs, rs[1:], strict=False):
                segmentation._better_share(left, right)
    assert [r.asDict() for r in got.orderBy("doc", "segment").collect()] == want["a"] + want["b"]
