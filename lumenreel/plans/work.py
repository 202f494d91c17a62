"""Queries of jobs, workers, runs, prompts and spans; orders, events and documents stand for the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import languages, times
from lumenreel.functions import text as T
from lumenreel.operators import jobs, profiles, quality, scenes, segmentation, words

from .registry import Tables, query

NOW = "TIMESTAMP '2024-02-01'"
WS = r"regexp_replace({c}, '\s+', ' ', 'g')"
WORDS = "list_filter(string_split(trim(" + WS.format(c="text") + "), ' '), lambda x: x <> '')"


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"


def lines(t: Tables, dealt: bool = False) -> DataFrame:
    """One row for each order and line number.

    `dealt` lines are dealt by order once, in a number of parts of its own: joins and windows by order need no other exchange, and parts
    that look small by their compressed bytes are not put together into few large tasks.
    """
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = t.lineitem.repartition(n, "l_orderkey") if dealt else t.lineitem
    return rows.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_quantity", "l_returnflag")])


def text_of(c) -> F.Column:
    return c.cast("string")


@query("""
WITH j AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' ELSE '' END AS status, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey % 9 END AS cur, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey % 8 END AS tot, o_orderkey % 5 AS n FROM orders),
t AS (SELECT *, coalesce(nullif(tot, 0), n) AS total FROM j), c AS (SELECT *, coalesce(cur, CASE WHEN status = 'completed' AND total > 0 THEN total END) AS current FROM t)
SELECT k AS o_orderkey, nullif(status, '') AS status, CAST(current AS INTEGER) AS current, CAST(total AS INTEGER) AS total, CAST(CASE WHEN current > 0 AND total > 0 THEN greatest(0, least(100, round_even(current / total * 100, 0))) END AS INTEGER) AS percent FROM c""")
def client_rows(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 3 == 0, " Completed").when(k % 3 == 1, "processing ").otherwise("")
    said = F.when(k % 4 < 2, F.concat(F.lit("Chunk "), text_of(k % 9), F.lit("/"), text_of(k % 8)))
    row = jobs.client_row(status, said, F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('"a"'), (k % 5).cast("int")), ","), F.lit("]")))
    return t.orders.select("o_orderkey", *[row[c].alias(c) for c in ("status", "current", "total", "percent")])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'de' WHEN o_orderkey % 7 = 0 THEN 'fr' WHEN o_orderkey % 11 = 0 AND o_orderkey % 2 = 1 THEN 'en' END AS language FROM orders""")
def job_languages(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    hint = F.when(k % 5 == 0, " de ").when(k % 3 == 0, "xx")
    first = F.when(k % 7 == 0, F.concat(F.lit("out/"), F.lit("Narration_fr_narration.WAV"))).otherwise(F.lit("narration_it.wav"))
    second = F.when(k % 11 == 0, F.when(k % 2 == 1, "a/narration_en.wav").otherwise("narration_en.mp3"))
    return t.orders.select("o_orderkey", jobs.language_of(hint, [first, second], F.array(F.lit("de"), F.lit("fr"), F.lit("en"))).alias("language"))


@query("""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT o_custkey, o_orderkey, r > 1 AS stopped, CASE WHEN r > 1 AND o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS requeued_job FROM w""")
def duplicate_workers(t: Tables) -> DataFrame:
    o = t.orders.withColumn("job", F.when(F.col("o_orderkey") % 3 == 0, text_of(F.col("o_orderkey"))).otherwise(F.lit(" ")))
    return jobs.single_worker(o, ["o_custkey"], "o_orderkey", "job", [F.col("o_orderstatus") == "P", F.col("o_orderdate")]).select("o_custkey", "o_orderkey", "stopped", "requeued_job")


@query("""
WITH f AS (SELECT 'f' || doc_id AS path, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 59) || '…' END AS body, n_chars, doc_id FROM documents)
SELECT c_custkey, coalesce(a.body, '') AS stdout_preview, coalesce(b.body, '') AS stderr_preview, a.n_chars AS stdout_size_bytes, b.n_chars AS stderr_size_bytes, a.doc_id AS stdout_updated_at, CASE WHEN c_custkey % 4 = 0 THEN 'bad' ELSE coalesce(b.body, '') END AS error_message
FROM customer LEFT JOIN f a ON a.path = 'f' || c_custkey LEFT JOIN f b ON b.path = 'f' || (c_custkey * 3)""")
def decorated_runs(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    runs = t.customer.select("c_custkey", F.concat(F.lit("f"), text_of(k)).alias("stdout_path"), F.concat(F.lit("f"), text_of(k * 3)).alias("stderr_path"), F.when(k % 4 == 0, "bad").when(k % 4 == 1, "").alias("error_text"))
    files = t.documents.select(F.concat(F.lit("f"), text_of(F.col("doc_id"))).alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size_bytes"), F.col("doc_id").alias("updated_at"))
    return jobs.decorated(runs, files, 60).select("c_custkey", "stdout_preview", "stderr_preview", "stdout_size_bytes", "stderr_size_bytes", "stdout_updated_at", "error_message")


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'test_voice' WHEN 1 THEN 'latents' ELSE 'generate' END AS kind, '{"texts":["t' || p_partkey || '"]' || CASE WHEN p_partkey % 2 = 0 THEN ',"original_filename":"n.wav"' ELSE '' END || '}' AS payload FROM part)
SELECT p_partkey, payload AS payload_json, CAST(CASE kind WHEN 'test_voice' THEN 0 WHEN 'latents' THEN 5 ELSE 10 END AS INTEGER) AS queue_priority, 'queued' AS status, sha256(kind || '|' || payload || '|2024-02-01 00:00:00') AS job_id FROM p""")
def job_submissions(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    asked = t.part.select("p_partkey", F.when(k % 3 == 0, "test_voice").when(k % 3 == 1, "latents").otherwise("generate").alias("kind"), F.array(F.concat(F.lit("t"), text_of(k))).alias("texts"), F.when(k % 2 == 0, "n.wav").alias("file"))
    return jobs.submissions(asked, "kind", "texts", "file", now()).select("p_partkey", "payload_json", "queue_priority", "status", "job_id")


@query("""
WITH c AS (SELECT conv_id, coalesce(list_filter(list(trim(text) ORDER BY turn) FILTER (role = 'system'), lambda x: x <> ''), []) AS texts, conv_id % 2 = 0 AS chunked, CASE WHEN conv_id % 3 = 0 THEN max(text) ELSE '' END AS single FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(texts) > 0 AND chunked THEN array_to_string(texts, '|') END AS texts, CASE WHEN len(texts) > 0 AND NOT chunked THEN array_to_string(texts, ' ') WHEN len(texts) = 0 THEN nullif(trim(single), '') END AS to_pack, CASE WHEN len(texts) = 0 AND trim(single) = '' THEN 'no text' END AS error FROM c""")
def resolved_texts(t: Tables) -> DataFrame:
    """Texts of a conversation's system turns, else its last text by name where the conversation brings one."""
    of_system = F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text")))
    rows = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(of_system), lambda x: x["text"]).alias("texts"), F.max("text").alias("single"))
    got = jobs.job_texts(F.col("texts"), F.col("conv_id") % 2 == 0, F.when(F.col("conv_id") % 3 == 0, F.col("single")).otherwise(""))
    return rows.select("conv_id", F.array_join(got["texts"], "|").alias("texts"), got["to_pack"].alias("to_pack"), got["error"].alias("error"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 's' WHEN doc_id % 3 = 0 THEN 'g' WHEN doc_id % 2 = 0 THEN 'r' END AS path,
 CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 OR doc_id % 2 = 0 THEN trim(text) WHEN lang = 'en' OR doc_id % 7 = 0 THEN 'source' END AS text,
 CASE WHEN NOT (doc_id % 5 = 0 OR doc_id % 3 = 0 OR doc_id % 2 = 0 OR lang = 'en' OR doc_id % 7 = 0) THEN 'no translated script for ' || lang END AS error FROM documents""")
def speech_sources(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    path = jobs.script_source(F.when(k % 5 == 0, "s"), F.when(k % 3 == 0, "g").otherwise(""), F.when(k % 2 == 0, "r"))
    got = jobs.speech_text(F.when(path.isNotNull(), F.col("text")), F.lit(" source "), F.col("lang"), F.lit(" "), F.when(k % 7 == 0, " Done").otherwise("failed"))
    return t.documents.select("doc_id", path.alias("path"), got["text"].alias("text"), got["error"].alias("error"))


@query("""
WITH s AS (SELECT *, CASE event_type WHEN 'click' THEN 'export' WHEN 'view' THEN 'upload' WHEN 'purchase' THEN 'check' ELSE 'render' END AS stage, CASE user_id % 5 WHEN 0 THEN 'upload' WHEN 1 THEN 'check' WHEN 2 THEN 'render' WHEN 3 THEN 'review' ELSE 'other' END AS target FROM events)
SELECT event_id, CASE target WHEN 'other' THEN 'no such stage' WHEN 'upload' THEN CASE WHEN stage <> 'export' OR event_id % 2 = 1 THEN 'export is not complete' END WHEN 'check' THEN CASE WHEN stage <> 'upload' THEN 'stages are out of order' END WHEN 'render' THEN CASE WHEN stage <> 'check' THEN 'stages are out of order' END ELSE CASE WHEN stage <> 'render' THEN 'stages are out of order' END END AS error FROM s""")
def assembly_steps(t: Tables) -> DataFrame:
    e, u = F.col("event_type"), F.col("user_id") % 5
    stage = F.when(e == "click", "export").when(e == "view", "upload").when(e == "purchase", "check").otherwise("render")
    target = F.when(u == 0, "upload").when(u == 1, "check").when(u == 2, "render").when(u == 3, "review").otherwise("other")
    return t.events.select("event_id", jobs.assembly_step(stage, F.when(F.col("event_id") % 2 == 1, "failed").otherwise("Done"), target, ("upload", "check", "render", "review")).alias("error"))


@query(f"""
WITH g AS (SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place, count(DISTINCT l_linenumber) OVER (PARTITION BY l_orderkey) AS n FROM {LINES}),
m AS (SELECT l_orderkey, l_linenumber * 10 AS chunk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {LINES} WHERE l_orderkey % 3 > 0 OR l_linenumber > 1)
SELECT g.l_orderkey, l_linenumber, chunk FROM g LEFT JOIN m ON m.l_orderkey = g.l_orderkey AND m.place = g.place AND m.n = g.n""")
def zipped_chunks(t: Tables) -> DataFrame:
    groups = lines(t, dealt=True).select("l_orderkey", "l_linenumber")
    meta = lines(t, dealt=True).where("l_orderkey % 3 > 0 or l_linenumber > 1").select("l_orderkey", F.col("l_linenumber").alias("at"), (F.col("l_linenumber") * 10).alias("chunk"))
    return scenes.zipped(groups, meta.withColumnRenamed("at", "l_linenumber"), "l_orderkey", "l_linenumber")


@query(f"""
WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS scene, CASE WHEN l_returnflag = 'A' THEN 'video' ELSE 'image' END AS asset_type FROM {LINES}),
a AS (SELECT l_orderkey * 10 + l_linenumber AS scene, 'v' || l_partkey AS prompt FROM {LINES} WHERE l_linenumber < 4), b AS (SELECT l_orderkey * 10 + l_linenumber AS scene, 'i' || l_partkey AS prompt FROM {LINES} WHERE l_linenumber IN (3, 5))
SELECT s.scene, asset_type, coalesce(b.prompt, a.prompt) AS prompt FROM s LEFT JOIN a USING (scene) LEFT JOIN b USING (scene) WHERE coalesce(b.prompt, a.prompt) IS NOT NULL""")
def scene_prompts(t: Tables) -> DataFrame:
    li = lines(t).withColumn("scene", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    s = li.select("scene", F.when(F.col("l_returnflag") == "A", "video").otherwise("image").alias("asset_type"))
    prompt = lambda mark, which: li.where(which).select("scene", F.concat(F.lit(mark), text_of(F.col("l_partkey"))).alias("prompt"))
    return scenes.with_prompts(s, [(prompt("v", "l_linenumber < 4"), "video"), (prompt("i", "l_linenumber in (3, 5)"), "image"), (prompt("x", "true"), "none")], "scene")


@query(r"""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS place FROM documents),
f AS (SELECT *, lower(regexp_replace(word, '[^\p{L}\p{M}\p{N}_]+', '', 'g')) AS form FROM w) SELECT doc_id, CAST(place AS INTEGER) AS place, form FROM f WHERE form <> ''""")
def recognised_words(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("place", "word"))
    return words.recognised(rows, "word").select("doc_id", "place", "form")


@query(f"""
WITH w AS (SELECT l_orderkey, l_linenumber - 1 AS i, 'w' || l_partkey AS word FROM {LINES}), r AS (SELECT o_orderkey, 1 AS part, 0 AS a, 3 AS b FROM orders UNION ALL SELECT o_orderkey, 2, 2, 6 FROM orders),
k AS (SELECT l_orderkey, part, i, a, word, row_number() OVER (PARTITION BY l_orderkey, part ORDER BY i) AS n, sum(length(word) + 1) OVER (PARTITION BY l_orderkey, part ORDER BY i) AS upto FROM w JOIN r ON o_orderkey = l_orderkey AND i >= a AND i < b)
SELECT l_orderkey, part, CAST(i - a AS INTEGER) AS "index", word, CAST(upto - length(word) - 1 AS BIGINT) AS "begin", CAST(upto - 1 AS BIGINT) AS stop FROM k""")
def script_subsets(t: Tables) -> DataFrame:
    w = F.concat(F.lit("w"), text_of(F.col("l_partkey")))
    tokens = lines(t).select("l_orderkey", (F.col("l_linenumber") - 1).cast("int").alias("index"), w.alias("word"), w.alias("form"))
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    ranges = o.select("l_orderkey", F.lit(1).alias("part"), F.lit(0).alias("from_"), F.lit(3).alias("to_")).unionAll(o.select("l_orderkey", F.lit(2), F.lit(2), F.lit(6)))
    return words.subset(tokens, ranges, "l_orderkey").select("l_orderkey", "part", F.col("index").cast("int").alias("index"), "word", "begin", "stop")


@query(f"""
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 9 AS n FROM {LINES}), g AS (SELECT l_orderkey FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey HAVING min(n) > 0 AND sum(n) = max(CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 0 END) + sum(n))
SELECT l_orderkey, l_linenumber, CAST(sum(n) OVER w - n AS BIGINT) AS "first", CAST(sum(n) OVER w - 1 AS BIGINT) AS "last" FROM s SEMI JOIN g USING (l_orderkey) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def seed_spans(t: Tables) -> DataFrame:
    s = lines(t).select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("bigint") % 9).alias("n"))
    totals = s.groupBy("l_orderkey").agg((F.sum("n") + F.when(F.col("l_orderkey") % 4 == 0, -1).otherwise(0)).alias("n_words"))
    return segmentation.seed_spans(s, "l_orderkey", "l_linenumber", "n", totals)


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 2 AS speed, 1 + l_linenumber % 2 AS n_lines, l_suppkey % 84 AS chars, l_partkey % 20 AS words FROM lineitem)
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY speed + CASE WHEN n_lines >= 2 THEN 0.3 ELSE 0.0 END + chars / 500.0::DOUBLE DESC, chars DESC, words DESC, l_linenumber DESC) AS rank FROM s WHERE speed >= 17.0 OR (n_lines >= 2 AND chars >= 74)""")
def dense_foci(t: Tables) -> DataFrame:
    s = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") / 2).alias("speed"), (1 + F.col("l_linenumber") % 2).alias("lines"), (F.col("l_suppkey") % 84).alias("chars"), (F.col("l_partkey") % 20).alias("words"))
    return segmentation.dense_foci(s, "l_orderkey", "l_linenumber")


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, o_orderkey % 40 AS spot, 5 AS a, 30 AS b, o_orderkey % 2 AS weak, o_orderkey % 3 AS bad FROM orders)
SELECT o_custkey, CAST(r - 1 AS INTEGER) AS place, spot FROM (SELECT o_custkey, spot, row_number() OVER (PARTITION BY o_custkey ORDER BY weak, bad, abs(spot - 17.5), spot - a) AS r FROM (SELECT DISTINCT o_custkey, spot, weak, bad, a, b FROM c) WHERE spot > a AND spot <= b) WHERE r <= 6""")
def split_places(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    c = t.orders.select("o_custkey", (k % 40).alias("spot"), F.lit(5).alias("first"), F.lit(30).alias("last"), (k % 2).alias("weak"), (k % 3).alias("bad")).distinct()
    return segmentation.split_positions(c, ["o_custkey"], "spot").select("o_custkey", "place", "spot")


@query("""
WITH s AS (SELECT n_name AS provider, p_partkey % 3 AS gone, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'm' || p_partkey END AS value, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS label FROM nation JOIN part ON p_partkey % 25 = n_nationkey)
SELECT provider, value, coalesce(nullif(label, ''), value) AS label FROM s WHERE value <> '' AND provider <> 'NATION_3' AND provider <> (SELECT n_name FROM nation WHERE n_nationkey = 3)
UNION ALL SELECT (SELECT n_name FROM nation WHERE n_nationkey = 3), c_name, c_name || ' - ' || c_mktsegment FROM customer WHERE c_custkey % 10 = 0""")
def merged_catalog(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    static = t.part.join(t.nation, k % 25 == F.col("n_nationkey")).select(F.col("n_name").alias("provider"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("m"), text_of(k))).alias("value"), F.when(k % 2 == 0, F.col("p_name")).alias("label"))
    found = t.customer.select(F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).alias("id"), F.lit(None).cast("string").alias("label"), F.col("c_mktsegment").alias("capability"))
    name = t.nation.where("n_nationkey = 3").first()["n_name"]
    return profiles.merged_catalog(static, found, name)


@query("""SELECT DISTINCT c_mktsegment AS model, c_mktsegment = (SELECT arg_min(c_mktsegment, lower(c_mktsegment)) FROM customer) AS recommended FROM customer""")
def discovered_models(t: Tables) -> DataFrame:
    return profiles.discovered_models(t.customer.select(F.concat(F.lit(" "), F.col("c_mktsegment")).alias("model")).unionAll(t.customer.select(F.lit(" "))), "model")


LABEL_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quality.LABELS.items())


@query("""
WITH q AS (SELECT doc_id, doc_id % 2 = 0 AS has, CASE doc_id % 3 WHEN 0 THEN ['digits_present'] WHEN 1 THEN [] ELSE ['english_cta_leak', 'digits_present'] END AS given, ['empty_output'] AS own, CASE WHEN doc_id % 5 = 0 THEN 'rate limit exceeded 429' ELSE '' END AS msg FROM documents),
c AS (SELECT *, CASE WHEN has THEN CASE WHEN len(given) > 0 THEN given ELSE own END WHEN msg <> '' THEN ['faithfulness'] ELSE [] END AS found FROM q),
l AS (SELECT *, list_filter(list_transform(found, lambda x: CASE x {LABEL_CASES} END), lambda x: x IS NOT NULL) AS labels FROM c)
SELECT doc_id, array_to_string(found, ',') AS categories, CASE WHEN has THEN doc_id % 4 = 0 END AS passed, CASE WHEN doc_id % 7 = 0 THEN 'short' WHEN len(labels) > 1 AND labels[1] <> labels[2] THEN labels[1] || ' and ' || labels[2] ELSE labels[1] END AS summary FROM l""".replace("{LABEL_CASES}", LABEL_CASES))
def feedback_rows(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    report = F.when(k % 2 == 0, F.struct(F.array(F.lit(" empty_output "), F.lit("")).alias("error_categories"), F.lit("").alias("error_summary"), (k % 4 == 0).alias("passed")))
    given = F.when(k % 3 == 0, F.array(F.lit("digits_present"))).when(k % 3 == 2, F.array(F.lit("english_cta_leak"), F.lit("digits_present")))
    got = quality.feedback(F.when(k % 5 == 0, "rate limit exceeded 429").otherwise(""), F.when(k % 7 == 0, "short"), given, report)
    return t.documents.select("doc_id", F.array_join(got["categories"], ",").alias("categories"), got["passed"].alias("passed"), got["summary"].alias("summary"))


@query("""SELECT doc_id, CASE lang WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' WHEN 'es' THEN 'es' ELSE CASE WHEN doc_id % 2 = 0 THEN 'zh-cn' ELSE 'en' END END AS code FROM documents""")
def speech_codes(t: Tables) -> DataFrame:
    lang = F.col("lang")
    code = F.when(lang.isin("de", "fr", "es"), F.concat(F.upper(lang), F.lit("-XX"))).when(F.col("doc_id") % 2 == 0, "zh-Hans").otherwise(F.when(F.col("doc_id") % 3 == 0, "tlh"))
    return t.documents.select("doc_id", languages.speech_code(code).alias("code"))


# operators that had no query of their own


@query(f"""SELECT event_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END AS stage, CAST(greatest(user_id, event_id % 7, 0) AS DOUBLE) AS recency,
  CASE WHEN event_type IN ('click', 'view') THEN event_type WHEN user_id % 2 = 0 THEN 'view' ELSE 'view' END AS start, CASE WHEN event_id % 3 = 0 THEN greatest(60 - user_id, 0) END AS shutdown, greatest((epoch_us({NOW}) - epoch_us(ts)) / 1000000, 0) AS age FROM events""")
def job_states(t: Tables) -> DataFrame:
    e = F.col("event_type")
    raw = F.when(e == "click", " Processing").when(e == "view", "queued").when(e == "purchase", "DONE").when(e == "error", "error").otherwise("whatever")
    start = jobs.start_stage(e, F.when(F.col("user_id") % 2 == 0, "view"), ("view", "click"))
    return t.events.select("event_id", jobs.stage_status(raw).alias("stage"), jobs.recency(F.col("user_id"), F.col("event_id") % 7, F.lit(None)).alias("recency"), start.alias("start"), jobs.shutdown_in(F.col("user_id"), F.col("event_id") % 3).alias("shutdown"), times.age_seconds(F.col("ts"), now()).alias("age"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN o_orderstatus WHEN o_orderkey % 4 < 1 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 4 < 2 THEN NULL ELSE o_orderpriority END AS b, CASE WHEN o_orderkey % 4 < 3 THEN NULL ELSE o_custkey END AS c FROM orders""")
def reset_outputs(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_custkey").alias("c"))
    k = F.col("o_orderkey") % 4
    stage = F.when(k == 0, "one").when(k == 1, "two").when(k == 2, "three").otherwise("elsewhere")
    return jobs.reset_from(o, stage, {"a": "one", "b": "two", "c": "three"}, ("one", "two", "three"))


@query("SELECT l_orderkey, CAST(least(max(l_linenumber) // 2 + 1, 3) AS INTEGER) AS resume_at FROM lineitem GROUP BY ALL")
def resume_places(t: Tables) -> DataFrame:
    return jobs.resume_index(t.lineitem, "l_orderkey", "l_linenumber", 3)


@query(f"""SELECT doc_id, array_to_string(list_slice({WORDS}, greatest(len({WORDS}) - 11, 1), len({WORDS})), ' ') AS tail, CASE WHEN length(text) <= 50 THEN text ELSE left(text, 49) || '…' END AS preview FROM documents WHERE text IS NOT NULL""")
def text_ends(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", T.last_words(F.col("text"), 12).alias("tail"), T.preview(F.col("text"), 50).alias("preview"))


@query("""SELECT page_id, trim(html, chr(10) || chr(13) || chr(9) || ' ') AS body FROM pages""")
def unfenced(t: Tables) -> DataFrame:
    whole = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("```html\n"), F.col("html"), F.lit("\n```"))).otherwise(F.col("html"))
    return t.pages.select("page_id", T.strip_fences(whole).alias("body"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 2 OR o_orderkey % 50 > 40 * 0.1 THEN (o_orderkey % 50) || ' of 40 segments read too fast' END AS warning, CASE WHEN o_custkey > 700 THEN 'duration' WHEN o_orderkey > 8000 THEN 'words' END AS reason FROM (SELECT *, o_orderkey % 7 AS x FROM orders)""")
def benchmark_warnings(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", segmentation.density_warning(k % 50, F.lit(40), F.when(k % 7 > 2, 31.0).otherwise(20.0)).alias("warning"), segmentation.too_long(k, F.col("o_custkey"), 8000, 700).alias("reason"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'http://local' ELSE 'https://h' || p_partkey || '/v1' END AS url, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'name is required' END, CASE WHEN p_partkey % 3 = 1 THEN 'key is required' END, CASE WHEN p_partkey % 5 = 0 THEN 'url is not valid' END, CASE WHEN p_partkey % 7 = 0 THEN 'provider can''t be run' END], lambda x: x IS NOT NULL), '; ') AS errors FROM part""")
def profile_checks(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    url = profiles.base_url(F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" https://h"), text_of(k), F.lit("/v1// "))), "http://local")
    errors = profiles.profile_errors(F.when(k % 2 == 0, " ").otherwise("n"), F.when(k % 3 != 1, "k"), F.lit("m"), F.when(k % 5 == 0, "ftp:/x").otherwise(""), k % 7 != 0)
    return t.part.select("p_partkey", url.alias("url"), F.array_join(errors, "; ").alias("errors"))


@query("""
WITH h AS (SELECT 'STANDARD' AS prefix, 1 AS priority, 2 AS price, 3 AS speed UNION ALL SELECT 'STANDARD BRUSHED', 0, 1, 5 UNION ALL SELECT 'ECONOMY', 4, 1, 1)
SELECT p_partkey, coalesce(arg_max(priority, length(prefix)), 999) AS priority, coalesce(arg_max(price, length(prefix)), 3) AS price, coalesce(arg_max(speed, length(prefix)), 3) AS speed FROM part LEFT JOIN h ON starts_with(p_type, prefix) GROUP BY p_partkey""")
def model_ranks(t: Tables) -> DataFrame:
    hints = t.spark.createDataFrame([("STANDARD", 1, 2, 3), ("STANDARD BRUSHED", 0, 1, 5), ("ECONOMY", 4, 1, 1)], "prefix string, priority int, price int, speed int")
    types = t.part.select("p_type").distinct()
    return t.part.join(profiles.model_scores(types, "p_type", hints), "p_type").select("p_partkey", "priority", "price", "speed")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'en,de' WHEN o_orderkey % 3 = 1 THEN 'de,en' ELSE 'en' END AS languages FROM orders""")
def target_languages(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    own = F.when(k % 3 == 0, F.array(F.lit(" de "), F.lit("de"))).when(k % 3 == 1, F.array(F.lit("de"), F.lit(" en"), F.lit("")))
    return t.orders.select("o_orderkey", F.array_join(profiles.languages(own, F.lit("en")), ",").alias("languages"))


def _rewritten(c: str) -> str:
    """SQL of a prompt's fragment without references to others."""
    c = f"replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ';', ',')"
    for pattern, to in T.PROMPT_REWRITES:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace({c}, '\\s*,\\s*', ', ', 'g'), ' ,;')"


_BANNED = ", ".join(f"CASE WHEN regexp_matches(line, '(?i){p}') THEN 'Prompt contains banned content matching {p}.' END" for p in T.PROMPT_BANNED)


@query(rf"""WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN 'the same ' || p_name || ' and five more words here now' ELSE p_name || chr(10) || ' as before, {{five}} more words here' END AS line,
  CASE WHEN p_partkey % 4 = 0 THEN ' ; ' ELSE '  same ' || p_name || ' ;' END AS part FROM part),
v AS (SELECT *, {_rewritten("part")} AS v FROM p)
SELECT p_partkey, CASE WHEN line = '' THEN 'Prompt is empty.' ELSE array_to_string(list_filter([CASE WHEN regexp_matches(line, '[\r\n]') THEN 'Prompt must be a single line.' END,
  CASE WHEN len(list_filter(string_split(regexp_replace(line, '\s+', ' ', 'g'), ' '), lambda x: x <> '')) < 6 THEN 'Prompt is too short to be useful.' END, {_BANNED}], lambda x: x IS NOT NULL), ' ') END AS errors,
  CASE WHEN v = '' THEN '' ELSE upper(left(v, 1)) || rtrim(substr(v, 2), ' .,:;') || '.' END AS sentence FROM v""")
def prompt_lines(t: Tables) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    line = F.when(k == 0, "").when(k == 1, name).when(k == 2, F.concat(F.lit("the same "), name, F.lit(" and five more words here now"))).otherwise(F.concat(name, F.lit("\n as before, {five} more words here")))
    part = F.when(k == 0, " ; ").otherwise(F.concat(F.lit("  same "), name, F.lit(" ;")))
    return t.part.select("p_partkey", F.array_join(T.prompt_errors(line), " ").alias("errors"), T.sentence(part).alias("sentence"))
