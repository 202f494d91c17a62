"""Documents that a stage hands to the next: guides, prompts, timelines, reviews; what is wrong with them and what becomes of an episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import text as T

# Fields of a guide, and the messages about it.
WORLD = ("setting", "look", "palette", "lighting", "camera_language", "negative_rules")
CHARACTER = ("character_id", "label", "visual_description", "wardrobe", "demeanor", "usage_notes")
GUIDE_MESSAGES = {
    "world": "Visual bible is missing world_style.%s.",
    "label": "Character %d is missing a label.",
    "description": "Character %d is missing a visual_description.",
    "continuity": "Visual bible must include at least one continuity rule.",
    "environment": "Visual bible must include at least one environment rule.",
    "nobody": "Visual bible did not define any recurring characters.",
}

_GUIDE = f"world_style struct<{', '.join(f'{c}: string' for c in WORLD)}>, characters array<struct<{', '.join(f'{c}: string' for c in CHARACTER)}>>, continuity_rules string, environment_rules string"


def _present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def clean_lines(c: Column) -> Column:
    """Collapsed lines of a JSON array or of a text, without empty ones; null gives none."""
    listed = F.from_json(F.when(F.startswith(F.ltrim(c), F.lit("[")), c), "array<string>")
    lines = F.coalesce(listed, F.split(F.coalesce(c, F.lit("")), "\r\n|\r|\n"))
    return _present(F.transform(lines, lambda v: T.collapse(F.coalesce(v, F.lit("")))))


def guide(payload: Column) -> Column:
    """(world_style, characters, continuity_rules, environment_rules, status, errors, warnings, character_count) of a guide's JSON.

    Fields are collapsed, missing ones are ''; characters without an id get one from their place.
    A text that is no JSON object reads as an empty guide.
    """
    clean = lambda c: T.collapse(F.coalesce(c, F.lit("")))

    def of(p: Column) -> Column:
        world = F.struct(*[clean(p["world_style"][c]).alias(c) for c in WORLD])
        given = F.transform(F.coalesce(p["characters"], F.array()), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
        own = lambda x: F.coalesce(F.nullif(clean(x["c"]["character_id"]), F.lit("")), F.format_string("character_%03d", x["i"] + 1))
        people = F.transform(F.filter(given, lambda x: x["c"].isNotNull()), lambda x: F.struct(own(x).alias("character_id"), *[clean(x["c"][c]).alias(c) for c in CHARACTER[1:]]))
        return F.struct(world.alias("world_style"), people.alias("characters"), clean_lines(p["continuity_rules"]).alias("continuity_rules"), clean_lines(p["environment_rules"]).alias("environment_rules"))

    def checked(g: Column) -> Column:
        say = GUIDE_MESSAGES
        of_world = F.array(*[F.when(g["world_style"][c] == "", F.lit(say["world"] % c)) for c in WORLD])
        lacks = lambda c, i: F.array(F.when(c["label"] == "", F.format_string(say["label"], i + 1)), F.when(c["visual_description"] == "", F.format_string(say["description"], i + 1)))
        of_rules = F.array(F.when(F.size(g["continuity_rules"]) == 0, F.lit(say["continuity"])), F.when(F.size(g["environment_rules"]) == 0, F.lit(say["environment"])))
        errors = _present(F.concat(of_world, F.flatten(F.transform(g["characters"], lacks)), of_rules))
        nobody = _present(F.array(F.when(F.size(g["characters"]) == 0, F.lit(say["nobody"]))))
        return F.struct(g["world_style"], g["characters"], g["continuity_rules"], g["environment_rules"], F.when(F.size(errors) == 0, F.lit("valid")).otherwise(F.lit("invalid")).alias("status"), errors.alias("errors"), nobody.alias("warnings"), F.size(g["characters"]).alias("character_count"))

    return T.let(T.let(F.from_json(F.coalesce(payload, F.lit("{}")), _GUIDE), of), checked)


PROMPT_FIELDS = ("subject", "setting", "action", "camera", "composition", "look", "lighting", "rules")


def paired_prompts(scenes: DataFrame, entries: DataFrame, key: str, place: str, mandatory: tuple[str, ...]) -> DataFrame:
    """Scenes (key, place, scene_id, asset_type) with the entry (scene_id, prompt and the fields) at the same place: prompt, and arrays of errors and warnings.

    An entry with all fields of its kind is composed anew, any other keeps its own line. Scenes without an entry are left out.
    """
    e = entries.select(key, place, F.nullif(T.collapse(F.coalesce("scene_id", F.lit(""))), F.lit("")).alias("_said"), T.collapse(F.coalesce("prompt", F.lit(""))).alias("_own"), *PROMPT_FIELDS)
    filled = lambda *names: F.forall(F.array(*[T.collapse(F.coalesce(F.col(c), F.lit(""))) for c in names]), lambda v: v != "")
    video = F.col("asset_type") == "video"
    whole = filled("subject", "setting", "look", "lighting") & F.when(video, filled("action", "camera")).otherwise(filled("composition"))
    composed = T.prompt_text(F.col("asset_type"), *[F.col(c) for c in ("subject", "setting", "action", "composition", "camera", "look", "lighting", "rules")], mandatory)
    rows = scenes.join(e, [key, place]).withColumn("prompt", F.when(whole, composed).otherwise(F.col("_own")))
    number = (F.col(place) + 1).cast("string")
    errors = F.transform(T.prompt_errors(F.col("prompt")), lambda m: F.concat(F.lit("Prompt "), number, F.lit(": "), m))
    other = F.when(F.col("_said") != F.col("scene_id"), F.concat(F.lit("Prompt "), number, F.lit(" referenced "), F.col("_said"), F.lit(", expected "), F.col("scene_id"), F.lit(".")))
    return rows.select(key, place, "scene_id", "asset_type", "prompt", errors.alias("errors"), _present(F.array(other)).alias("warnings"))


def prompt_report(scenes: DataFrame, entries: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, status, n_errors, n_warnings, count_error, scene_count, prompt_count) of each episode that has scenes; `pairs` come from `paired_prompts`."""
    n = scenes.groupBy(key).agg(F.count("*").alias("scene_count"))
    m = entries.groupBy(key).agg(F.count("*").alias("prompt_count"))
    found = pairs.groupBy(key).agg(F.sum(F.size("errors")).alias("_e"), F.sum(F.size("warnings")).alias("_w"))
    out = n.join(m, key, "left").join(found, key, "left").withColumn("prompt_count", F.coalesce("prompt_count", F.lit(0)))
    count_error = F.when(F.col("scene_count") != F.col("prompt_count"), F.concat(F.lit("Prompt count mismatch: expected "), F.col("scene_count").cast("string"), F.lit(", received "), F.col("prompt_count").cast("string"), F.lit(".")))
    n_errors = F.coalesce("_e", F.lit(0)) + count_error.isNotNull().cast("int")
    return out.select(key, F.when(n_errors == 0, F.lit("valid")).otherwise(F.lit("invalid")).alias("status"), n_errors.alias("n_errors"), F.coalesce("_w", F.lit(0)).alias("n_warnings"), count_error.alias("count_error"), "scene_count", "prompt_count")


#: Of each stage, the column of its state, what it is called in a reason, and the reason where its output is missing.
STAGE_CHECKS = {
    "translation": ("translation_status", "translation", "missing translated script assets"),
    "tts": ("tts_status", "tts", "missing narration audio"),
    "alignment": ("srt_status", "alignment", "missing aligned SRT"),
    "timeline_mapping": ("timeline_status", "timeline", "missing localized timeline"),
}


def stage_blockers(episodes: DataFrame, statuses: DataFrame, episode: str, language: str, stage: str, output: Column) -> DataFrame:
    """(episode, language, reason, error_message): the configured languages of each episode in which a stage isn't done or has no output.

    `episodes` has `languages`, an array; `statuses` has one row for each episode and language;
    `output` says of a joined row whether what the stage makes is there. Null states are pending.
    """
    column, called, missing = STAGE_CHECKS[stage]
    wanted = episodes.withColumn(language, F.explode("languages"))
    rows = wanted.join(statuses.withColumn("_known", F.lit(True)), [episode, language], "left")
    state = F.lower(F.trim(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("pending"))))
    shown = F.coalesce(F.nullif(state, F.lit("")), F.lit("pending"))
    reason = (
        F.when(F.col("_known").isNull(), F.lit("missing language status"))
        .when(state != "done", F.concat(F.lit(f"{called} status is '"), shown, F.lit("'")))
        .when(~F.coalesce(output, F.lit(False)), F.lit(missing))
    )
    return rows.select(episode, language, reason.alias("reason"), F.trim(F.coalesce("error_message", F.lit(""))).alias("error_message")).where("reason is not null")


def paused_actions(episodes: DataFrame, translation: DataFrame, speech: DataFrame, statuses: DataFrame, queue: DataFrame, episode: str) -> DataFrame:
    """(episode, action) of each episode that waits for speech.

    `episodes` has pause_requested, `translation` and `speech` are rows of `stage_blockers`, `queue`
    has (active_jobs, submitted_jobs, blocked) of each episode. A failed translation comes first, then
    a queue that can't be filled; open languages wait while jobs are active, and fail without any;
    with none open, an episode with failed speech fails and any other goes on to alignment, or pauses there.
    """
    open_ = statuses.where(F.lower(F.trim(F.coalesce(F.nullif(F.col("tts_status"), F.lit("")), F.lit("pending")))).isin("queued", "running", "pending")).select(episode).distinct().withColumn("_open", F.lit(True))
    flag = lambda df, name: df.select(episode).distinct().withColumn(name, F.lit(True))
    rows = episodes.join(flag(translation, "_translation"), episode, "left").join(flag(speech, "_speech"), episode, "left").join(open_, episode, "left").join(queue, episode, "left")
    is_open, active = F.coalesce(F.col("_open"), F.lit(False)), F.coalesce(F.col("active_jobs"), F.lit(0)) > 0
    action = (
        F.when(F.col("_translation"), F.lit("fail_translation"))
        .when(F.col("blocked"), F.lit("fail_blocked"))
        .when(is_open & active & (F.col("submitted_jobs") > 0), F.lit("requeued"))
        .when(is_open & active, F.lit("wait"))
        .when(is_open | F.col("_speech"), F.lit("fail_speech"))
        .when(F.col("pause_requested"), F.lit("pause_at_alignment"))
        .otherwise(F.lit("resume_at_alignment"))
    )
    return rows.select(episode, action.alias("action"))


#: Columns that running a stage again for one language sets back; None empties a column.
RETRIES = {
    "translation": {"translation_status": "pending", "script_path": None, "spoken_script_path": None},
    "tts": {"tts_status": "pending"},
    "alignment": {"srt_status": "pending", "srt_path": None, "timeline_status": "pending", "timeline_path": None},
    "timeline_mapping": {"timeline_status": "pending", "timeline_path": None},
}
STAGE_NAMES = {"srt": "alignment", "timeline": "timeline_mapping"}


def retried(statuses: DataFrame, requests: DataFrame, running: DataFrame, keys: list[str]) -> DataFrame:
    """`statuses` with retry_stage and retry_error after `requests` (keys, stage), one for each row at most: the columns of the stage are set back, the error message goes.

    Episodes in `running` (first key) and unknown stages change nothing and say so.
    """
    r = requests.select(*keys, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGE_NAMES.items() for x in kv]), F.col("stage")), F.col("stage")).alias("retry_stage"))
    rows = statuses.join(r, keys, "left").join(running.select(keys[0]).distinct().withColumn("_busy", F.lit(True)), keys[0], "left")
    error = F.when(F.col("retry_stage").isNull(), None).when(F.col("_busy"), F.lit("running")).when(~F.col("retry_stage").isin(*RETRIES), F.lit("not supported"))
    rows = rows.withColumn("retry_error", error)
    goes = lambda *stages: F.coalesce(F.col("retry_stage").isin(*stages) & F.col("retry_error").isNull(), F.lit(False))
    columns = {c: [s for s, sets in RETRIES.items() if c in sets] for sets in RETRIES.values() for c in sets}
    value = lambda c: F.lit(RETRIES[columns[c][0]][c]).cast("string")
    return rows.withColumns({c: F.when(goes(*stages), value(c)).otherwise(F.col(c)) for c, stages in columns.items()} | {"error_message": F.when(goes(*RETRIES), None).otherwise(F.col("error_message"))}).drop("_busy")


def expand_subject(subject: Column, people: Column) -> Column:
    """The subject with a descriptor behind the first mention of each of the first three people.

    `people` is an array of (display_name, aliases, descriptor). A descriptor that stands in the text
    already is not set again; where none is set, the first two people with their descriptors open the text.
    """
    described = lambda p: F.coalesce(p["descriptor"], F.lit("")) != ""
    start = F.struct(T.collapse(F.coalesce(subject, F.lit(""))).alias("text"), F.lit(False).alias("set"))
    pattern = lambda a: F.concat(F.lit(r"(?iU)\b\Q"), a, F.lit(r"\E\b"))

    def put(acc: Column, p: Column) -> Column:
        hits = F.filter(p["aliases"], lambda a: F.regexp_like(acc["text"], pattern(a)))
        alias = F.try_element_at(hits, F.lit(1))
        hit = F.regexp_substr(acc["text"], pattern(alias))
        at = F.regexp_instr(acc["text"], pattern(alias)) + F.length(hit)
        text = F.concat(F.substring(acc["text"], F.lit(1), at - 1), F.lit(" ("), p["descriptor"], F.lit(")"), F.substring(acc["text"], at, F.length(acc["text"])))
        skip = ~described(p) | F.contains(F.lower(acc["text"]), F.lower(p["descriptor"])) | alias.isNull()
        return F.when(F.coalesce(skip, F.lit(True)), acc).otherwise(F.struct(text.alias("text"), F.lit(True).alias("set")))

    def end(acc: Column) -> Column:
        first = F.transform(F.filter(F.slice(people, 1, 2), described), lambda p: F.concat(F.coalesce(F.nullif(p["display_name"], F.lit("")), F.try_element_at(p["aliases"], F.lit(1))), F.lit(" ("), p["descriptor"], F.lit(")")))
        opening = F.array_join(first, " and ")
        lowered = F.concat(F.lower(F.left(acc["text"], F.lit(1))), F.substring(acc["text"], 2, 1 << 30))
        return T.collapse(F.when(acc["set"] | (F.size(first) == 0), acc["text"]).when(acc["text"] == "", opening).otherwise(F.concat(opening, F.lit(", "), lowered)))

    return F.aggregate(F.slice(people, 1, 3), start, put, end)


#: Fields that a timeline must have, and those of a project given without any.
PROJECT_FIELDS = ("fps", "width", "height", "voiceover_file")
SCENE_FIELDS = ("scene_id", "asset_id", "asset_type", "asset_file", "start", "end", "duration")
PROJECT_DEFAULTS = {"fps": "30", "width": "1920", "height": "1080", "voiceover_file": "voiceover.wav"}
MOTION, RETIME = '{"enabled":false,"mode":"static"}', '{"enabled":false,"mode":"auto"}'


def timeline(content: Column, asset_file: Column | None = None) -> Column:
    """(fps, width, height, voiceover_file, subtitle_file, scenes, errors) of a timeline's JSON.

    A bare array of scenes gets the default project, ids by place, and asset files from the map
    `asset_file` by scene (a blank frame where that has none); an object has to name everything.
    Scenes that lack a field or hold a wrong number are left out and told of in errors; any error
    makes the timeline unusable, which is for the caller to act on.
    """
    bare = F.startswith(F.ltrim(content), F.lit("["))
    as_map, as_maps = "map<string,string>", "array<map<string,string>>"
    defaults = F.create_map(*[F.lit(x) for kv in PROJECT_DEFAULTS.items() for x in kv])
    files = asset_file if asset_file is not None else F.create_map().cast(as_map)
    only = lambda mark, c: F.when(F.startswith(c, F.lit(mark)), c)
    whole = F.struct(
        F.when(bare, defaults).otherwise(F.from_json(only("{", F.get_json_object(content, "$.project")), as_map)).alias("project"),
        F.from_json(F.when(bare, content).otherwise(only("[", F.get_json_object(content, "$.scenes"))), as_maps).alias("scenes"),
        F.coalesce(bare, F.lit(False)).alias("bare"),
    )

    def of(t: Column) -> Column:
        has = lambda m, k: F.coalesce(F.map_contains_key(m, k), F.lit(False))
        project = F.coalesce(t["project"], F.create_map().cast(as_map))

        def full(s: Column, i: Column) -> Column:
            number = F.format_string("%03d", i + 1)
            scene = F.coalesce(s["scene_id"], F.concat(F.lit("scene_"), number))
            found = F.try_element_at(files, scene)
            extra = F.map_from_arrays(
                F.array(*[F.lit(k) for k in ("asset_id", "asset_file", "asset_type", "motion", "retime")]),
                F.array(F.concat(F.lit("asset_"), number), F.coalesce(found, F.lit("assets/blank.png")), F.when(T.suffix_class(found) == "video", F.lit("video")).otherwise(F.lit("image")), F.lit(MOTION), F.lit(RETIME)),
            )
            return F.when(t["bare"], F.map_concat(s, F.map_filter(extra, lambda k, _: ~F.map_contains_key(s, k)))).otherwise(s)

        def row(s: Column, i: Column) -> Column:
            scope = F.concat(F.lit("scene["), (i + 1).cast("string"), F.lit("]"))
            lacks = F.transform(F.filter(F.array(*[F.lit(c) for c in SCENE_FIELDS]), lambda k: ~has(s, k)), lambda k: F.concat(scope, F.lit(" is missing required field `"), k, F.lit("`.")))
            numbers = [s[c].try_cast("double") for c in ("start", "end", "duration")]
            wrong = F.when((F.size(lacks) == 0) & (numbers[0].isNull() | numbers[1].isNull() | numbers[2].isNull()), F.concat(scope, F.lit(" contains invalid numeric data")))
            spec = lambda k, mode: F.struct(F.coalesce(F.get_json_object(s[k], "$.enabled") == "true", F.lit(False)).alias("enabled"), F.coalesce(F.get_json_object(s[k], "$.mode"), F.lit(mode)).alias("mode"))
            scene = F.struct(s["scene_id"].alias("scene_id"), s["asset_id"].alias("asset_id"), F.lower(s["asset_type"]).alias("asset_type"), s["asset_file"].alias("asset_file"), *[n.alias(c) for n, c in zip(numbers, ("start", "end", "duration"), strict=True)], F.coalesce(s["text"], F.lit("")).alias("text"), spec("motion", "static").alias("motion"), spec("retime", "auto").alias("retime"))
            errors = F.when(s.isNull(), F.array(F.concat(scope, F.lit(" must be an object.")))).otherwise(_present(F.array_append(lacks, wrong)))
            return F.struct(scene.alias("scene"), errors.alias("errors"))

        rows = F.transform(F.transform(F.coalesce(t["scenes"], F.array().cast(as_maps)), full), row)
        of_project = F.array(
            F.when(t["project"].isNull(), F.lit("`project` must be an object.")),
            F.when(t["scenes"].isNull(), F.lit("`scenes` must be an array.")),
            *[F.when(~has(project, c), F.lit(f"project is missing required field `{c}`.")) for c in PROJECT_FIELDS],
        )
        scenes = F.transform(F.filter(rows, lambda r: F.size(r["errors"]) == 0), lambda r: r["scene"])
        return F.struct(
            *[project[c].try_cast("int").alias(c) for c in PROJECT_FIELDS[:3]], project["voiceover_file"].alias("voiceover_file"), F.nullif(project["subtitle_file"], F.lit("")).alias("subtitle_file"),
            scenes.alias("scenes"), F.concat(_present(of_project), F.flatten(F.transform(rows, lambda r: r["errors"]))).alias("errors"),
        )

    return T.let(whole, of)


#: Parts into which rows that meet nothing in a join are dealt, so that they don't go to one task.
DEALS = 1 << 16


def translation_preview(statuses: DataFrame, episodes: DataFrame, files: DataFrame, reports: DataFrame, episode: str, language: str) -> DataFrame:
    """(episode, language, original, translated, translation_status, error_message) of each language: the script file, else the text in the report (translated_script, error_message).

    Rows without a path meet no file; they are dealt out by themselves, as they would all go to one task by their path.
    """
    deal = lambda *by: F.pmod(F.xxhash64(*by), F.lit(DEALS))
    f = files.select(F.col("path").alias("script_path"), F.col("content").alias("_file")).withColumn("_deal", deal("script_path"))
    e = episodes.select(episode, F.coalesce("script_text", F.lit("")).alias("original"))
    dealt = statuses.withColumn("_deal", F.when(F.col("script_path").isNull(), deal(episode, language)).otherwise(deal("script_path")))
    rows = dealt.join(e, episode).join(f, ["script_path", "_deal"], "left").join(reports.select(episode, language, "translated_script", F.col("error_message").alias("_said")), [episode, language], "left")
    translated = F.coalesce(F.nullif(F.col("_file"), F.lit("")), F.trim(F.coalesce("translated_script", F.lit(""))))
    error = F.trim(F.coalesce(F.nullif(F.col("error_message"), F.lit("")), F.nullif(F.col("_said"), F.lit("")), F.lit("")))
    return rows.select(episode, language, "original", translated.alias("translated"), F.coalesce("translation_status", F.lit("pending")).alias("translation_status"), error.alias("error_message"))


def sections(episode: str, parts: dict[str, DataFrame]) -> DataFrame:
    """(episode, section, body): rows of several tables in one, each as JSON without the episode. A detail view or a review is all rows of one episode; none is gathered here."""
    out = None
    for name, df in parts.items():
        part = df.select(episode, F.lit(name).alias("section"), F.to_json(F.struct(*[c for c in df.columns if c != episode])).alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


def accepted(updates: DataFrame, issues: DataFrame, episode: str) -> DataFrame:
    """Updates of episodes without any issue: one error keeps all updates of its episode from being written."""
    return updates.join(issues.select(episode).distinct(), episode, "left_anti")


