"""Queries of guides, prompts, timelines, reviews and waiting episodes; orders and lineitem stand for the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.operators import payloads, segmentation

from .registry import Tables, query
from .work import LINES, lines, text_of

def order() -> Column:
    return F.col("o_orderkey")


def by(n: Column, *values) -> Column:
    """The value whose place is the remainder of n."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


@query("""
WITH b AS (SELECT o_orderkey, o_orderkey AS k FROM orders),
e AS (SELECT *, list_filter([CASE WHEN k % 5 = 0 THEN 'Visual bible is missing world_style.look.' END, CASE WHEN k % 7 = 0 THEN 'Visual bible is missing world_style.negative_rules.' END, CASE WHEN k % 6 = 1 THEN 'Character 1 is missing a visual_description.' END, CASE WHEN k % 3 = 2 AND k % 4 = 0 THEN 'Character 2 is missing a label.' END, CASE WHEN k % 8 = 0 THEN 'Visual bible must include at least one continuity rule.' END, CASE WHEN k % 9 = 0 THEN 'Visual bible must include at least one environment rule.' END], lambda x: x IS NOT NULL) AS errors FROM b)
SELECT o_orderkey, CASE WHEN len(errors) = 0 THEN 'valid' ELSE 'invalid' END AS status, array_to_string(errors, '|') AS errors, CASE WHEN k % 3 = 0 THEN 'Visual bible did not define any recurring characters.' ELSE '' END AS warnings, CAST(k % 3 AS INTEGER) AS character_count,
CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 0 THEN 'character_001' ELSE 'c1' END AS first_id, 'a b' AS palette, CASE WHEN k % 3 = 0 THEN '' WHEN k % 6 = 1 THEN '' WHEN k % 3 = 1 THEN 'd 1' ELSE 'd 1,d 2' END AS people,
CASE WHEN k % 8 = 0 THEN '' ELSE 'r 1' END AS continuity, CASE WHEN k % 9 = 0 THEN '' ELSE 'one,two' END AS environment FROM e""")
def guide_reports(t: Tables) -> DataFrame:
    world = F.struct(F.col("o_orderpriority").alias("setting"), F.when(order() % 5 == 0, "").otherwise("oil").alias("look"), F.lit("  a   b ").alias("palette"), F.lit("x").alias("lighting"), F.lit("y").alias("camera_language"), F.when(order() % 7 != 0, "z").alias("negative_rules"))
    person = lambda i: F.struct(F.when(order() % 2 == 1, F.concat(F.lit("c"), text_of(i))).alias("character_id"), F.when((i == 2) & (order() % 4 == 0), "").otherwise(F.concat(F.lit("L"), text_of(i))).alias("label"), F.when(order() % 6 == 1, "  ").otherwise(F.concat(F.lit("d  "), text_of(i))).alias("visual_description"))
    people = F.slice(F.transform(F.array(F.lit(1), F.lit(2)), person), F.lit(1), (order() % 3).cast("int"))
    rules = F.when(order() % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" r 1"), F.lit("")))
    payload = F.to_json(F.struct(world.alias("world_style"), people.alias("characters"), rules.alias("continuity_rules"), F.when(order() % 9 != 0, "one\n\n two").alias("environment_rules")))
    g = t.orders.select("o_orderkey", payloads.guide(payload).alias("g"))
    joined = lambda c, by_: F.array_join(F.col(f"g.{c}"), by_)
    return g.select(
        "o_orderkey", "g.status", joined("errors", "|").alias("errors"), joined("warnings", "|").alias("warnings"), "g.character_count", F.try_element_at("g.characters", F.lit(1))["character_id"].alias("first_id"),
        "g.world_style.palette", F.array_join(F.filter(F.col("g.characters.visual_description"), lambda d: d != ""), ",").alias("people"), joined("continuity_rules", ",").alias("continuity"), joined("environment_rules", ",").alias("environment"),
    )


_PAIRS = rf"""
WITH s AS (SELECT l_orderkey, l_linenumber - 1 AS place, l_linenumber AS n, l_partkey AS p, CASE WHEN l_returnflag = 'A' THEN 'video' ELSE 'image' END AS kind FROM {LINES}),
r AS (SELECT *, CASE WHEN p % 3 = 0 THEN CASE kind WHEN 'video' THEN 'Man in port, walking. Slow pan. Ink. Dusk. None, no text.' ELSE 'Man in port, wide. Ink. Dusk. None, no text.' END
  WHEN p % 4 = 0 THEN 'one two three' WHEN p % 4 = 1 THEN 'a man walks by the same old harbour' ELSE 'a man walks by the old harbour' END AS prompt FROM s WHERE p % 7 > 0),
x AS (SELECT *, CASE WHEN p % 3 = 0 THEN '' WHEN p % 4 = 0 THEN 'Prompt ' || n || ': Prompt is too short to be useful.' WHEN p % 4 = 1 THEN 'Prompt ' || n || ': Prompt contains banned content matching \bsame\b.' ELSE '' END AS errors,
  CASE WHEN p % 5 = 0 THEN 'Prompt ' || n || ' referenced s99, expected s' || n || '.' ELSE '' END AS warnings FROM r)"""


def _scenes(t: Tables) -> DataFrame:
    return lines(t).select("l_orderkey", (F.col("l_linenumber") - 1).alias("place"), F.concat(F.lit("s"), text_of(F.col("l_linenumber"))).alias("scene_id"), F.when(F.col("l_returnflag") == "A", "video").otherwise("image").alias("asset_type"))


def _entries(t: Tables) -> DataFrame:
    p = F.col("l_partkey")
    own = F.when(p % 4 == 0, " one  two three").when(p % 4 == 1, "a man walks by the same old harbour").otherwise("a man walks by the old harbour")
    said = F.when(p % 5 == 0, F.lit("s99")).when(p % 5 == 1, F.concat(F.lit(" s"), text_of(F.col("l_linenumber"))))
    fixed = {"setting": "port", "action": "walking", "camera": "slow pan", "composition": "wide", "look": "ink", "lighting": "dusk", "rules": "none"}
    return lines(t).where(p % 7 > 0).select("l_orderkey", (F.col("l_linenumber") - 1).alias("place"), said.alias("scene_id"), own.alias("prompt"), F.when(p % 3 == 0, "man").alias("subject"), *[F.lit(v).alias(c) for c, v in fixed.items()])


@query(_PAIRS + " SELECT l_orderkey, place, prompt, errors, warnings FROM x")
def paired_prompts(t: Tables) -> DataFrame:
    pairs = payloads.paired_prompts(_scenes(t), _entries(t), "l_orderkey", "place", ("no text",))
    return pairs.select("l_orderkey", "place", "prompt", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


@query(
    _PAIRS
    + """, n AS (SELECT l_orderkey, count(*) AS a FROM s GROUP BY ALL), m AS (SELECT l_orderkey, count(*) AS b, count(*) FILTER (errors <> '') AS e, count(*) FILTER (warnings <> '') AS w FROM x GROUP BY ALL),
j AS (SELECT l_orderkey, a AS scene_count, coalesce(b, 0) AS prompt_count, coalesce(e, 0) + CASE WHEN a <> coalesce(b, 0) THEN 1 ELSE 0 END AS n_errors, coalesce(w, 0) AS n_warnings FROM n LEFT JOIN m USING (l_orderkey))
SELECT l_orderkey, CASE WHEN n_errors = 0 THEN 'valid' ELSE 'invalid' END AS status, n_errors, n_warnings, CASE WHEN scene_count <> prompt_count THEN 'Prompt count mismatch: expected ' || scene_count || ', received ' || prompt_count || '.' END AS count_error, scene_count, prompt_count FROM j"""
)
def prompt_reports(t: Tables) -> DataFrame:
    s, e = _scenes(t), _entries(t)
    return payloads.prompt_report(s, e, payloads.paired_prompts(s, e, "l_orderkey", "place", ("no text",)), "l_orderkey")


_STATES = f"""
WITH e AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS has_text, unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['en', 'de', 'fr'] ELSE ['en', 'de'] END) AS language FROM orders),
s AS (SELECT l_orderkey AS o_orderkey, ['en', 'de', 'fr', 'es', 'it', 'pt', 'pl'][l_linenumber] AS language, CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'R' THEN 'failed' ELSE 'pending' END AS tr, CASE l_partkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'queued' ELSE 'pending' END AS sp,
  l_partkey % 2 = 0 AS script, l_partkey % 4 < 2 AS audio, CASE WHEN l_partkey % 5 = 0 THEN 'boom' ELSE '' END AS error_message FROM {LINES}),
j AS (SELECT e.o_orderkey, e.language, has_text, tr, sp, script, audio, coalesce(error_message, '') AS error_message FROM e LEFT JOIN s ON s.o_orderkey = e.o_orderkey AND s.language = e.language),
r AS (SELECT 'translation' AS stage, *, CASE WHEN tr IS NULL THEN 'missing language status' WHEN tr <> 'done' THEN 'translation status is ''' || tr || '''' WHEN NOT (script OR (language = 'en' AND has_text)) THEN 'missing translated script assets' END AS reason FROM j
  UNION ALL SELECT 'tts', *, CASE WHEN sp IS NULL THEN 'missing language status' WHEN sp <> 'done' THEN 'tts status is ''' || sp || '''' WHEN NOT audio THEN 'missing narration audio' END FROM j)"""


def _episodes(t: Tables) -> DataFrame:
    every = F.array(F.lit("en"), F.lit("de"), F.lit("fr"))
    return t.orders.select("o_orderkey", F.when(order() % 3 == 0, every).otherwise(F.slice(every, 1, 2)).alias("languages"), (order() % 2 == 0).alias("has_text"), (order() % 5 == 0).alias("pause_requested"))


def _statuses(t: Tables) -> DataFrame:
    p, flag = F.col("l_partkey"), F.col("l_returnflag")
    return lines(t).select(
        F.col("l_orderkey").alias("o_orderkey"), F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es", "it", "pt", "pl")]), F.col("l_linenumber").cast("int")).alias("language"), F.when(flag == "A", " Done").when(flag == "R", "failed").alias("translation_status"),
        by(p, "done", "queued", "").alias("tts_status"), (p % 2 == 0).alias("script"), (p % 4 < 2).alias("audio"), F.when(p % 5 == 0, " boom ").alias("error_message"),
    )


def _blockers(t: Tables, stage: str) -> DataFrame:
    there = F.col("audio") if stage == "tts" else F.col("script") | ((F.col("language") == "en") & F.col("has_text"))
    return payloads.stage_blockers(_episodes(t), _statuses(t), "o_orderkey", "language", stage, there)


@query(_STATES + " SELECT stage, o_orderkey, language, reason, error_message FROM r WHERE reason IS NOT NULL")
def stage_blockers(t: Tables) -> DataFrame:
    every = [_blockers(t, stage).select(F.lit(stage).alias("stage"), "o_orderkey", "language", "reason", "error_message") for stage in ("translation", "tts")]
    return every[0].unionByName(every[1])


@query(
    _STATES
    + """, f AS (SELECT o_orderkey, bool_or(stage = 'translation' AND reason = 'translation status is ''failed''') AS bad, bool_or(stage = 'tts' AND reason IS NOT NULL) AS speech FROM r GROUP BY ALL),
o AS (SELECT o_orderkey, bool_or(sp <> 'done') AS open FROM s GROUP BY ALL)
SELECT o_orderkey, CASE WHEN bad THEN 'fail_translation' WHEN o_orderkey % 11 = 0 THEN 'fail_blocked' WHEN coalesce(open, false) AND o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 2 = 1 THEN 'requeued' ELSE 'wait' END WHEN coalesce(open, false) OR speech THEN 'fail_speech' WHEN o_orderkey % 5 = 0 THEN 'pause_at_alignment' ELSE 'resume_at_alignment' END AS action FROM f LEFT JOIN o USING (o_orderkey)"""
)
def paused_actions(t: Tables) -> DataFrame:
    failed = _blockers(t, "translation").where("reason = \"translation status is 'failed'\"")
    queue = t.orders.select("o_orderkey", (order() % 3).alias("active_jobs"), (order() % 2).alias("submitted_jobs"), (order() % 11 == 0).alias("blocked"))
    return payloads.paused_actions(_episodes(t), failed, _blockers(t, "tts"), _statuses(t), queue, "o_orderkey")


@query(f"""
WITH s AS (SELECT l_orderkey AS o_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 1 THEN CASE l_partkey % 5 WHEN 0 THEN 'alignment' WHEN 1 THEN 'timeline_mapping' WHEN 2 THEN 'tts' WHEN 3 THEN 'translation' ELSE 'export' END END AS retry_stage, o_orderstatus = 'F' AND o_orderkey % 4 = 0 AS busy FROM {LINES} JOIN orders ON o_orderkey = l_orderkey),
e AS (SELECT *, CASE WHEN retry_stage IS NULL THEN NULL WHEN busy THEN 'running' WHEN retry_stage = 'export' THEN 'not supported' END AS retry_error FROM s), g AS (SELECT *, CASE WHEN retry_error IS NULL THEN coalesce(retry_stage, '') ELSE '' END AS does FROM e)
SELECT o_orderkey, l_linenumber, retry_stage, retry_error, CASE WHEN does = 'translation' THEN 'pending' ELSE 'done' END AS translation_status, CASE WHEN does <> 'translation' THEN 's' END AS script_path, CASE WHEN does <> 'translation' THEN 'p' END AS spoken_script_path, CASE WHEN does = 'tts' THEN 'pending' ELSE 'done' END AS tts_status,
CASE WHEN does = 'alignment' THEN 'pending' ELSE 'done' END AS srt_status, CASE WHEN does <> 'alignment' THEN 'x' END AS srt_path, CASE WHEN does IN ('alignment', 'timeline_mapping') THEN 'pending' ELSE 'done' END AS timeline_status, CASE WHEN does NOT IN ('alignment', 'timeline_mapping') THEN 't' END AS timeline_path, CASE WHEN does = '' THEN 'e' END AS error_message FROM g""")
def language_retries(t: Tables) -> DataFrame:
    made = {"translation_status": "done", "script_path": "s", "spoken_script_path": "p", "tts_status": "done", "srt_status": "done", "srt_path": "x", "timeline_status": "done", "timeline_path": "t", "error_message": "e"}
    own = t.orders.select("o_orderkey", "o_orderstatus").join(lines(t).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    statuses = own.select("o_orderkey", "l_linenumber", *[F.lit(v).alias(c) for c, v in made.items()])
    requests = own.where("l_partkey % 2 = 1").select("o_orderkey", "l_linenumber", by(F.col("l_partkey"), "srt", "timeline", "tts", "translation", "export").alias("stage"))
    running = t.orders.where("o_orderstatus = 'F' and o_orderkey % 4 = 0").select("o_orderkey")
    return payloads.retried(statuses, requests, running, ["o_orderkey", "l_linenumber"])


@query(r"""
WITH b AS (SELECT o_orderkey, o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Old Anna walks' WHEN 1 THEN 'A bridge at night' WHEN 2 THEN '' ELSE 'anna, (grey coat) and Bo' END AS e FROM orders),
x AS (SELECT *, CASE WHEN k % 3 <> 1 AND NOT contains(lower(e), 'grey coat') THEN regexp_replace(e, '(?i)\b(anna)\b', '\1 (grey coat)') ELSE e END AS f FROM b),
y AS (SELECT *, CASE WHEN k % 3 <> 2 AND NOT contains(lower(f), 'tall') THEN regexp_replace(f, '(?i)\b(bo)\b', '\1 (tall)') ELSE f END AS g, CASE k % 3 WHEN 0 THEN 'Anna K (grey coat) and Bobby (tall)' WHEN 1 THEN 'Bobby (tall)' ELSE 'Anna K (grey coat)' END AS opening FROM x)
SELECT o_orderkey, CASE WHEN g <> e THEN g WHEN e = '' THEN opening ELSE opening || ', ' || lower(left(e, 1)) || substr(e, 2) END AS subject FROM y""")
def expanded_subjects(t: Tables) -> DataFrame:
    person = lambda name, aliases, d: F.struct(F.lit(name).alias("display_name"), F.array(*map(F.lit, aliases)).alias("aliases"), F.lit(d).alias("descriptor"))
    anna, bo, cy = person("", ["Anna K", "Anna"], "grey coat"), person("Bobby", ["Bo"], "tall"), person("Cy", ["Cy"], "")
    subject = by(order(), "Old  Anna walks", "A bridge at night ", "", "anna, (grey coat) and Bo")
    return t.orders.select("o_orderkey", payloads.expand_subject(subject, by(order(), F.array(anna, bo), F.array(cy, bo), F.array(anna))).alias("subject"))


@query("""
SELECT o_orderkey, CASE k WHEN 0 THEN 30 WHEN 3 THEN NULL ELSE 25 END AS fps, CASE WHEN k = 0 THEN 'voiceover.wav' WHEN k = 1 THEN 'v.wav' END AS voiceover_file, CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS n_scenes, CASE k WHEN 0 THEN 2.5 WHEN 1 THEN CAST(o_orderkey % 10 AS DOUBLE) END AS end_at,
CASE k WHEN 0 THEN 'static' WHEN 1 THEN 'pan' END AS motion, CASE k WHEN 0 THEN 'image' WHEN 1 THEN 'video' END AS asset_type, CASE k WHEN 0 THEN 'assets/blank.png' WHEN 1 THEN 'f' END AS asset_file,
CASE k WHEN 0 THEN 'scene[2] contains invalid numeric data|scene[3] is missing required field `scene_id`.|scene[3] is missing required field `start`.' WHEN 1 THEN '' WHEN 2 THEN '`scenes` must be an array.|project is missing required field `width`.|project is missing required field `height`.|project is missing required field `voiceover_file`.'
ELSE '`project` must be an object.|project is missing required field `fps`.|project is missing required field `width`.|project is missing required field `height`.|project is missing required field `voiceover_file`.|scene[1] is missing required field `asset_id`.|scene[1] is missing required field `asset_type`.|scene[1] is missing required field `asset_file`.|scene[1] is missing required field `start`.|scene[1] is missing required field `end`.|scene[1] is missing required field `duration`.' END AS errors
FROM (SELECT o_orderkey, o_orderkey % 4 AS k FROM orders)""")
def timeline_loads(t: Tables) -> DataFrame:
    bare = '[{"scene_id":"a","start":0,"end":2.5,"duration":2.5,"text":"t"},{"scene_id":"b","start":"bad","end":1,"duration":1},{"end":1,"duration":1}]'
    whole = '{"project":{"fps":25,"width":1280,"height":720,"voiceover_file":"v.wav","subtitle_file":""},"scenes":[{"scene_id":"a","asset_id":"b","asset_type":"VIDEO","asset_file":"f","start":0,"end":%d,"duration":1,"motion":{"enabled":true,"mode":"pan"}}]}'
    content = by(order(), bare, F.format_string(whole, order() % 10), '{"project":{"fps":25},"scenes":{}}', '{"scenes":[{"scene_id":"a"}]}')
    got = t.orders.select("o_orderkey", payloads.timeline(content).alias("t"))
    first = F.try_element_at(F.col("t.scenes"), F.lit(1))
    return got.select(
        "o_orderkey", "t.fps", "t.voiceover_file", F.size("t.scenes").alias("n_scenes"), first["end"].alias("end_at"), first["motion"]["mode"].alias("motion"), first["asset_type"].alias("asset_type"), first["asset_file"].alias("asset_file"), F.array_join("t.errors", "|").alias("errors"),
    )


@query(f"""
WITH s AS (SELECT l_orderkey AS o_orderkey, 'l' || l_linenumber AS language, l_linenumber AS n, l_partkey AS p, l_returnflag AS f FROM {LINES}), k AS (SELECT DISTINCT l_partkey AS q FROM {LINES} WHERE l_partkey % 2 = 0)
SELECT o_orderkey, language, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS original, CASE WHEN p % 3 > 0 AND p % 2 = 0 AND p % 5 > 0 THEN 'text ' || p WHEN n % 2 = 1 THEN 'r' ELSE '' END AS translated, CASE WHEN f = 'A' THEN 'done' ELSE 'pending' END AS translation_status,
CASE WHEN f = 'R' THEN 'e' WHEN n % 2 = 1 THEN 'said' ELSE '' END AS error_message FROM s JOIN orders USING (o_orderkey)""")
def translation_previews(t: Tables) -> DataFrame:
    p, flag = F.col("l_partkey"), F.col("l_returnflag")
    own = lines(t).withColumnsRenamed({"l_orderkey": "o_orderkey"}).withColumn("language", F.concat(F.lit("l"), text_of(F.col("l_linenumber"))))
    path = F.concat(F.lit("p"), text_of(p))
    statuses = own.select("o_orderkey", "language", F.when(p % 3 > 0, path).alias("script_path"), F.when(flag == "A", "done").alias("translation_status"), F.when(flag == "R", " e ").otherwise("").alias("error_message"))
    files = own.where(p % 2 == 0).select(path.alias("path"), F.when(p % 5 == 0, "").otherwise(F.concat(F.lit("text "), text_of(p))).alias("content")).distinct()
    reports = own.where("l_linenumber % 2 = 1").select("o_orderkey", "language", F.lit(" r ").alias("translated_script"), F.lit("said").alias("error_message"))
    episodes = t.orders.select("o_orderkey", F.when(order() % 2 == 0, F.col("o_orderpriority")).alias("script_text"))
    return payloads.translation_preview(statuses, episodes, files, reports, "o_orderkey", "language")


@query(f"""
SELECT o_orderkey, 'episode' AS section, CAST(to_json({{'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority}}) AS VARCHAR) AS body FROM orders
UNION ALL SELECT l_orderkey, 'languages', CAST(to_json({{'l_linenumber': l_linenumber, 'l_returnflag': l_returnflag}}) AS VARCHAR) FROM {LINES}""")
def detail_sections(t: Tables) -> DataFrame:
    languages = lines(t).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    return payloads.sections("o_orderkey", {"episode": t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "languages": languages})


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)")
def accepted_updates(t: Tables) -> DataFrame:
    issues = t.lineitem.where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return payloads.accepted(t.orders.select("o_orderkey", "o_orderpriority"), issues, "o_orderkey")


@query()
def swept_gaps(t: Tables) -> DataFrame:
    """No SQL: each share depends on the one before it. Tested against a plain loop."""
    start = F.col("l_linenumber") * 3.0
    rows = lines(t, dealt=True).select("l_orderkey", F.col("l_linenumber").cast("int").alias("segment"), start.alias("start"), (start + F.col("l_quantity").cast("double") / 18).alias("end"), (F.col("l_partkey") % 80 + 5).cast("int").alias("chars"))
    shared = segmentation.share_gaps(rows.withColumns({"raw_start": F.col("start"), "raw_end": F.col("end")}), "l_orderkey")
    return segmentation.sweep_gaps(shared, "l_orderkey")
