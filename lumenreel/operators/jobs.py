"""Jobs of languages: which counts, how far it is, and what becomes of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import text as T

# States of jobs, as ranks and as states of a stage.
RANKS = {"processing": 3, "queued": 2, "completed": 1, "done": 1, "failed": 0, "error": 0, "canceled": 0}
STAGES = {"processing": "running", "queued": "queued", "completed": "done", "done": "done", "error": "failed", "failed": "failed"}
ACTIVE = ("queued", "processing")
FINISHED = ("completed", "done")


def _mapped(c: Column, values: dict, default) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(F.coalesce(c, F.lit(""))))), F.lit(default))


def rank(status: Column) -> Column:
    return _mapped(status, RANKS, -1)


def stage_status(status: Column) -> Column:
    return _mapped(status, STAGES, "pending")


def recency(*times: Column) -> Column:
    """The latest of several times in seconds; null counts as 0."""
    return F.greatest(*[F.coalesce(t.cast("double"), F.lit(0.0)) for t in times])


def best(jobs: DataFrame, group: list[str], job: str, status: str, updated: str, created: str, active_job: Column) -> DataFrame:
    """The job of each group that counts most: the one that a worker has, then by state, then the latest; of equals the one created last, then the largest id."""
    mine = F.coalesce((F.col(job) == active_job).cast("int"), F.lit(0))
    order = F.struct(mine.alias("a"), rank(F.col(status)).alias("b"), F.col(updated).alias("c"), F.col(created).alias("d"), F.col(job).alias("e"))
    rest = [c for c in jobs.columns if c not in group]
    return jobs.groupBy(*group).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*group, *[F.col(f"_row.{c}") for c in rest])


def effective(jobs: DataFrame, group: list[str], job: str, status: str, time: str, has_result: Column, active_job: Column) -> DataFrame:
    """(group, job, status, time): the best active job, unless the latest finished one is as late or later and the active one isn't in work right now."""
    s = F.lower(F.trim(F.coalesce(F.col(status), F.lit(""))))
    active, done = s.isin(*ACTIVE), s.isin(*FINISHED) & has_result
    row = F.struct(F.col(job).alias("job"), F.col(status).alias("status"), F.col(time).alias("time"))
    mine = F.coalesce((F.col(job) == active_job).cast("int"), F.lit(0))
    picked = jobs.groupBy(*group).agg(
        F.max_by(F.when(active, row), F.when(active, F.struct(mine.alias("a"), rank(s).alias("b"), F.col(time).alias("c"), F.col(job).alias("d")))).alias("act"),
        F.max_by(F.when(done, row), F.when(done, F.struct(F.col(time).alias("c"), F.col(job).alias("d")))).alias("fin"),
    )
    live = F.coalesce((F.lower(F.col("act.status")) == "processing") & (F.col("act.job") == active_job), F.lit(False))
    wins = F.col("fin").isNotNull() & (F.col("act").isNull() | (~live & (F.col("fin.time") >= F.col("act.time"))))
    chosen = F.when(wins, F.col("fin")).otherwise(F.col("act"))
    return picked.select(*group, chosen.alias("_row")).where("_row is not null").select(*group, F.col("_row.job").alias(job), F.col("_row.status").alias(status), F.col("_row.time").alias(time))


def cancel_superseded(jobs: DataFrame, group: list[str], status: str, time: str) -> DataFrame:
    """Queued jobs that are no later than a finished one of their group are canceled."""
    done = jobs.where(F.col(status).isin(*FINISHED)).groupBy(*group).agg(F.max(time).alias("_done"))
    late = F.coalesce((F.col(status) == "queued") & (F.col(time) <= F.col("_done")), F.lit(False))
    return jobs.join(done, group, "left").withColumn(status, F.when(late, F.lit("canceled")).otherwise(F.col(status))).drop("_done")


def cancel_for(jobs: DataFrame, languages: DataFrame, language: str, status: str, control: str) -> DataFrame:
    """Jobs of the languages: those in work get the order to stop, those queued or over are canceled."""
    hit = jobs.join(languages.select(language).distinct().withColumn("_hit", F.lit(True)), language, "left")
    on = F.coalesce(F.col("_hit"), F.lit(False))
    return hit.withColumns({
        control: F.when(on & (F.col(status) == "processing"), F.lit("stop")).otherwise(F.col(control)),
        status: F.when(on & F.col(status).isin("queued", "failed", *FINISHED), F.lit("canceled")).otherwise(F.col(status)),
    }).drop("_hit")


def control(stop: Column, canceled: Column, paused: Column) -> Column:
    """What a worker does next; stopping comes before pausing."""
    return F.when(stop | canceled, F.lit("stop")).when(paused, F.lit("pause")).otherwise(F.lit("go on"))


def tone(*statuses: Column) -> Column:
    """One word for several stages: error, info, warn, success or neutral."""
    every = F.array(*statuses)
    some = lambda s: F.exists(every, lambda x: F.coalesce(x, F.lit("")) == s)
    whole = F.forall(every, lambda x: F.coalesce(x, F.lit("")) == "done")
    return F.when(some("failed"), F.lit("error")).when(some("running"), F.lit("info")).when(some("queued"), F.lit("warn")).when(whole, F.lit("success")).when(some("done"), F.lit("warn")).otherwise(F.lit("neutral"))


def board_column(board: Column, pipeline: Column, stage: Column, queued_from: Column, stages: tuple[str, ...]) -> Column:
    """The column of a card on the board."""
    known = lambda c: F.coalesce(c.isin(*stages), F.lit(False))
    waits = (pipeline == "queued") | ((pipeline == "running") & (stage == "draft"))
    moving = pipeline.isin("queued", "running", "paused", "paused_for_speech")
    return (
        F.when((board == "Needs Attention") | (pipeline == "failed"), F.lit("needs_attention"))
        .when((board == "Done") | (stage == "export") | (pipeline == "done"), F.lit("export"))
        .when((board == "Review") | (stage == "review") | (pipeline == "review"), F.lit("review"))
        .when(waits & known(queued_from), queued_from)
        .when(known(stage), stage)
        .when(moving & known(queued_from), queued_from)
        .otherwise(F.lit("draft"))
    )


def start_stage(stage: Column, queued_from: Column, runnable: tuple[str, ...]) -> Column:
    """Where an episode goes on: its stage if it can be run, else where it was queued from, else the first."""
    return F.coalesce(F.when(stage.isin(*runnable), stage), F.when(queued_from.isin(*runnable), queued_from), F.lit(runnable[0]))


def reset_from(df: DataFrame, stage: Column, outputs: dict[str, str], stages: tuple[str, ...]) -> DataFrame:
    """Outputs (column -> its stage) of the given stage and later ones become null."""
    order = F.array(*[F.lit(s) for s in stages])
    at = F.array_position(order, stage)
    return df.withColumns({c: F.when((at > 0) & (at <= stages.index(s) + 1), F.lit(None)).otherwise(F.col(c)) for c, s in outputs.items()})


def resume_index(parts: DataFrame, job: str, number: str, total: int) -> DataFrame:
    """(job, resume_at): two parts make one text; work goes on behind the highest part that is whole."""
    top = parts.groupBy(job).agg(F.max(number).alias("_top"))
    return top.select(job, F.least(F.floor(F.col("_top") / 2) + 1, F.lit(total)).cast("int").alias("resume_at"))


def worker_health(beats: DataFrame, worker: str, at: str, status: str, job: str, now: Column, seconds: int) -> DataFrame:
    """(worker, state): stopped, stale, busy or idle, from the latest beat of each worker."""
    last = beats.groupBy(worker).agg(F.max_by(F.struct(F.col(at).alias("at"), F.col(status).alias("status"), F.col(job).alias("job")), F.col(at)).alias("b"))
    old = F.col("b.at") < now - F.make_dt_interval(secs=F.lit(seconds))
    state = F.when(F.col("b.status") == "stopped", F.lit("stopped")).when(old, F.lit("stale")).when(F.col("b.job").isNotNull(), F.lit("busy")).otherwise(F.lit("idle"))
    return last.select(worker, state.alias("state"), F.col("b.at").alias("last_beat"))


def shutdown_in(idle_seconds: Column, active_jobs: Column, cooldown: int = 60) -> Column:
    """Seconds until an idle worker ends; null while there is work."""
    return F.when(active_jobs == 0, F.greatest(F.lit(cooldown) - idle_seconds, F.lit(0)))


def client_row(status: Column, progress: Column, texts: Column) -> Column:
    """(status, progress, current, total, percent) of a job as a client sees it.

    The total is that of the progress text, else the number of texts of the JSON array `texts`; a
    completed job without a count of its own has come to the total.
    """
    state, said = F.lower(F.trim(F.coalesce(status, F.lit("")))), F.trim(F.coalesce(progress, F.lit("")))
    parsed = T.progress(F.coalesce(progress, F.lit("")))
    total = F.coalesce(F.nullif(parsed["total"], F.lit(0)), F.json_array_length(texts))
    current = F.coalesce(parsed["current"], F.when((state == "completed") & (total > 0), total))
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.struct(blank(state).alias("status"), blank(said).alias("progress"), current.alias("current"), total.alias("total"), T.percent_done(current, total).alias("percent"))


#: How a file of speech is named after its language.
SPEECH_FILE = r"(?i)^narration_(.+?)(?:_narration)?\.wav$"


def language_of(hint: Column, files: list[Column], configured: Column) -> Column:
    """Language of a job: the hint, else that in the first file name that gives one; only configured languages count, all where none is configured."""
    names = [F.trim(F.regexp_extract(F.regexp_extract(F.coalesce(f, F.lit("")), r"([^/]*)$", 1), SPEECH_FILE, 1)) for f in files]
    known = lambda c: F.when((c != "") & ((F.size(configured) == 0) | F.array_contains(configured, c)), c)
    return F.coalesce(*[known(c) for c in [F.trim(F.coalesce(hint, F.lit(""))), *names]])


def single_worker(workers: DataFrame, group: list[str], worker: str, job: str, order: list[Column]) -> DataFrame:
    """`workers` with stopped and requeued_job: of each group the worker highest in `order` stays, the others stop and their job goes back to the queue."""
    best_ = workers.groupBy(*group).agg(F.max_by(F.col(worker), F.struct(*order, F.col(worker))).alias("_kept"))
    out = workers.join(best_, group)
    stopped = F.col(worker) != F.col("_kept")
    return out.select(*workers.columns, stopped.alias("stopped"), F.when(stopped, F.nullif(F.trim(F.col(job).cast("string")), F.lit(""))).alias("requeued_job"))


def decorated(runs: DataFrame, files: DataFrame, limit: int = 4000) -> DataFrame:
    """`runs` (stdout_path, stderr_path, error_text, ...) with preview, size and time of both files, and error_message: the error text, else what stands on stderr, else ''.

    `files` has (path, content, size_bytes, updated_at), one row a path.
    """
    out = runs
    for name in ("stdout", "stderr"):
        f = files.select(F.col("path").alias(f"{name}_path"), T.preview(F.col("content"), limit).alias(f"{name}_preview"), F.col("size_bytes").alias(f"{name}_size_bytes"), F.col("updated_at").alias(f"{name}_updated_at"))
        out = out.join(f, f"{name}_path", "left").withColumn(f"{name}_preview", F.coalesce(f"{name}_preview", F.lit("")))
    return out.withColumn("error_message", F.coalesce(F.nullif(F.col("error_text"), F.lit("")), F.col("stderr_preview")))


#: Priorities of new jobs by kind; a lower one goes first.
PRIORITIES = {"test_voice": 0, "latents": 5}


def submissions(requests: DataFrame, kind: str, texts: str, filename: str, at: Column) -> DataFrame:
    """`requests` as queued jobs: an id from what is asked for, the payload as JSON (the file's name in it where it has one), its priority and times."""
    payload = F.to_json(F.struct(F.col(texts).alias("texts"), F.col(filename).alias("original_filename")))
    priority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv]), F.col(kind)), F.lit(10))
    made = requests.withColumns({"payload_json": payload, "queue_priority": priority, "status": F.lit("queued"), "progress": F.lit("Queued..."), "created_at": at, "updated_at": at})
    return made.withColumn("job_id", F.sha2(F.concat_ws("|", F.col(kind), "payload_json", F.col("created_at").cast("string")), 256))


def job_texts(texts: Column, chunked: Column, text: Column) -> Column:
    """(texts, to_pack, error): texts that are cut already stay; others are joined and have to be packed, as has a single text; with neither there is an error."""
    own = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")
    single = F.trim(F.coalesce(text, F.lit("")))
    cut = (F.size(own) > 0) & F.coalesce(chunked, F.lit(False))
    whole = F.nullif(F.when(F.size(own) > 0, F.array_join(own, " ")).otherwise(single), F.lit(""))
    return F.struct(F.when(cut, own).alias("texts"), F.when(~cut, whole).alias("to_pack"), F.when(~cut & whole.isNull(), F.lit("no text")).alias("error"))


def script_source(spoken: Column, generated: Column, readable: Column) -> Column:
    """Path of the script to speak: the spoken one, else one made from the readable one, else the readable one itself; '' counts as missing."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (spoken, generated, readable)])


def speech_text(script: Column, source: Column, language: Column, master: Column, translation: Column) -> Column:
    """(text, error): the script, else the source text for the master language and for rows whose translation is done; else an error."""
    main = F.coalesce(F.nullif(F.trim(master), F.lit("")), F.lit("en"))
    falls_back = (language == main) | (F.lower(F.trim(F.coalesce(translation, F.lit("")))) == "done")
    text = F.when(script.isNotNull(), F.trim(script)).when(falls_back, F.trim(F.coalesce(source, F.lit(""))))
    return F.struct(text.alias("text"), F.when(text.isNull(), F.concat(F.lit("no translated script for "), language)).alias("error"))


def assembly_step(stage: Column, status: Column, target: Column, sequence: tuple[str, ...]) -> Column:
    """Why an episode can't go to an assembly stage; null if it can. The first stage follows a finished export, any other the one before it."""
    order = F.array(*[F.lit(s) for s in sequence])
    at = F.array_position(order, target)
    before = F.try_element_at(order, F.greatest(at - 1, F.lit(1)).cast("int"))
    first = F.when((stage != "export") | (F.lower(status) != "done"), F.lit("export is not complete"))
    return F.when(at == 0, F.lit("no such stage")).when(at == 1, first).when(stage != before, F.lit("stages are out of order"))
