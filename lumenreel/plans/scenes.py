"""Queries over scenes as a model answers them, their checks, files and texts: order lines play scenes, turns play cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import languages
from lumenreel.operators import assets, cues, jobs, scenes
from lumenreel.sources import subtitles

from .media import CUES_SQL, cue_rows
from .registry import Tables, query
from .work import LINES, lines, text_of

#: Fields of an answer as texts: times in seconds, some of them no numbers, some scenes that end before they start, some that only mark a gap.
ANSWERS_SQL = f"""
a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 > 0 THEN l_linenumber * 10.5 END AS s, l_linenumber * 10.5 + CAST(l_quantity AS BIGINT) % 7 - 1 AS e, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_quantity AS BIGINT) % 5 END AS d,
  CASE WHEN l_returnflag = 'A' THEN '' ELSE 'scene ' || l_returnflag END AS text, CASE WHEN l_partkey % 3 = 0 THEN 'Gap absorbed' ELSE '' END AS notes FROM {LINES}),
m AS (SELECT l_orderkey, l_linenumber, CAST(round(s * 1000) AS BIGINT) AS start_ms, CAST(round(e * 1000) AS BIGINT) AS end_ms, coalesce(CAST(round(d * 1000) AS BIGINT), CAST(round(e * 1000) AS BIGINT) - CAST(round(s * 1000) AS BIGINT)) AS duration_ms, text, notes FROM a),
k AS (SELECT *, coalesce(text = '' AND NOT (end_ms > start_ms AND duration_ms > 0) AND notes <> '', false) AS mark FROM m),
w AS (SELECT *, start_ms IS NOT NULL AND (mark OR end_ms <= start_ms OR text = '') AS weak FROM k),
t AS (SELECT *, bool_and(weak) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM w)"""


def answers(t: Tables) -> DataFrame:
    n, q, p = F.col("l_linenumber"), F.col("l_quantity").cast("bigint"), F.col("l_partkey")
    start, end = text_of(n * 10.5), text_of(n * 10.5 + q % 7 - 1)
    text = F.when(F.col("l_returnflag") == "A", "  ").otherwise(F.concat(F.lit("scene  "), F.col("l_returnflag"), F.lit("\n")))
    return lines(t).select("l_orderkey", "l_linenumber", F.when(p % 11 > 0, start).otherwise("n/a").alias("start"), end.alias("end"), F.when(p % 2 == 0, text_of(q % 5)).alias("duration"), text.alias("text"), F.when(p % 3 == 0, "Gap absorbed").alias("notes"))


@query(f"""WITH {ANSWERS_SQL} SELECT l_orderkey, l_linenumber, start_ms, end_ms, duration_ms, text, CASE WHEN start_ms IS NULL THEN 'Invalid numeric field.' WHEN end_ms <= start_ms THEN 'Scene ends before it starts.' WHEN text = '' THEN 'Scene has no text.' END AS error,
  CASE WHEN abs(end_ms - start_ms - duration_ms) > 350 THEN 'Scene duration does not match start/end.' END AS warning FROM t WHERE NOT mark AND NOT tail""")
def cleaned_scenes(t: Tables) -> DataFrame:
    got = scenes.clean(answers(t), ["l_orderkey"], "l_linenumber")
    return got.select("l_orderkey", "l_linenumber", "start_ms", "end_ms", "duration_ms", "text", "error", "warning")


CHECKED_SQL = f"""
g AS (SELECT l_orderkey, l_linenumber, l_linenumber * 1000 - l_partkey % 4 * 30 AS start_ms, (l_linenumber + 1) * 1000 - CASE WHEN l_partkey % 5 = 0 THEN 2500 ELSE 0 END + CASE WHEN l_partkey % 7 = 0 THEN 20000 ELSE 0 END AS end_ms,
  CASE WHEN CAST(l_quantity AS BIGINT) % 3 = 0 THEN 400 ELSE 0 END AS off, CASE l_returnflag WHEN 'A' THEN 'image' WHEN 'R' THEN 'video' ELSE 'audio' END AS asset_type FROM {LINES}),
p AS (SELECT *, lag(end_ms) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev, end_ms - start_ms + off AS said FROM g),
c AS (SELECT *, array_to_string(list_filter([CASE WHEN end_ms <= start_ms THEN 'ends_before_start' END, CASE WHEN off > 350 THEN 'duration_mismatch' END, CASE WHEN asset_type = 'audio' THEN 'bad_type' END, CASE WHEN start_ms < prev - 50 THEN 'overlap' END], lambda x: x IS NOT NULL), ',') AS codes,
  array_to_string(list_filter([CASE WHEN said < 1000 THEN 'very_short' END, CASE WHEN said > 18000 THEN 'very_long' END, CASE WHEN start_ms - prev > 500 THEN 'gap' END, CASE WHEN start_ms - prev > 50 AND start_ms - prev <= 500 THEN 'small_gap' END], lambda x: x IS NOT NULL), ',') AS warnings FROM p)"""


def checked(t: Tables) -> DataFrame:
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    start, end = n * 1000 - p % 4 * 30, (n + 1) * 1000 - F.when(p % 5 == 0, 2500).otherwise(0) + F.when(p % 7 == 0, 20_000).otherwise(0)
    kind = F.when(F.col("l_returnflag") == "A", "image").when(F.col("l_returnflag") == "R", "video").otherwise("audio")
    said = end - start + F.when(F.col("l_quantity").cast("bigint") % 3 == 0, 400).otherwise(0)
    return scenes.checks(lines(t).select("l_orderkey", "l_linenumber", start.alias("start_ms"), end.alias("end_ms"), said.alias("duration_ms"), kind.alias("asset_type")), "l_orderkey", ["l_linenumber"])


@query(f"WITH {CHECKED_SQL} SELECT l_orderkey, l_linenumber, codes, warnings FROM c")
def scene_problems(t: Tables) -> DataFrame:
    """What is wrong with each scene by itself and after the one before it."""
    return checked(t).select("l_orderkey", "l_linenumber", F.array_join("codes", ",").alias("codes"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {CHECKED_SQL}, n AS (SELECT *, CASE WHEN codes = '' THEN 0 ELSE len(string_split(codes, ',')) END AS e, CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, ',')) END AS w FROM c),
r AS (SELECT l_orderkey, count(*) AS scenes, CAST(sum(e) AS BIGINT) AS e, CAST(sum(w) AS BIGINT) AS warnings, arg_min(start_ms, l_linenumber) AS a, arg_max(end_ms, l_linenumber) AS b FROM n GROUP BY ALL),
s AS (SELECT r.*, a - (1000 - o_orderkey % 2 * 4000) AS head_gap_ms, 3000 + o_custkey % 9 * 1000 - b AS tail_gap_ms FROM r JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT *, e + CASE WHEN head_gap_ms > 3000 THEN 1 ELSE 0 END + CASE WHEN tail_gap_ms > 3000 THEN 1 ELSE 0 END AS errors FROM s)
SELECT l_orderkey, scenes, CAST(errors AS BIGINT) AS errors, warnings, CASE WHEN errors = 0 THEN 'valid' ELSE 'invalid' END AS status, b - a AS total_ms, head_gap_ms, tail_gap_ms FROM f""")
def timeline_problems(t: Tables) -> DataFrame:
    """Reports on timelines with errors in many of them, against cues that begin before and end behind some of them."""
    c = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (1000 - F.col("o_orderkey") % 2 * 4000).alias("start_ms"), (3000 + F.col("o_custkey") % 9 * 1000).alias("end_ms"))
    got = scenes.report(checked(t), "l_orderkey", "l_linenumber", c)
    return got.select("l_orderkey", "scenes", F.col("errors").cast("bigint").alias("errors"), F.col("warnings").cast("bigint").alias("warnings"), "status", "total_ms", "head_gap_ms", "tail_gap_ms")


@query(f"""WITH c AS (SELECT o_orderkey, o_custkey % 5 * 4000 AS a, o_custkey % 5 * 4000 + 9000 AS b FROM orders),
s AS (SELECT l_orderkey, l_linenumber, l_linenumber * 1000 + CASE WHEN l_orderkey % 2 = 0 THEN a ELSE 0 END AS s FROM {LINES} JOIN c ON o_orderkey = l_orderkey),
k AS (SELECT l_orderkey, CASE WHEN a > 1000 AND min(s) < a - 5000 AND max(s + 1500) <= b - a + 3000 THEN a ELSE 0 END AS by FROM s JOIN c ON o_orderkey = l_orderkey GROUP BY l_orderkey, a, b)
SELECT l_orderkey, l_linenumber, s + "by" AS start_ms, s + 1500 + "by" AS end_ms, "by" > 0 AS rebased FROM s JOIN k USING (l_orderkey)""")
def rebased_scenes(t: Tables) -> DataFrame:
    """Scenes of chunks, in half of them counted from the chunk's start."""
    start = F.col("o_custkey") % 5 * 4000
    chunks = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), start.alias("from_ms"), (start + 9000).alias("to_ms"))
    at = F.col("l_linenumber") * 1000 + F.when(F.col("l_orderkey") % 2 == 0, F.col("from_ms")).otherwise(0)
    rows = lines(t, dealt=True).join(chunks, "l_orderkey").select("l_orderkey", "l_linenumber", at.alias("start_ms"), (at + 1500).alias("end_ms"))
    return scenes.rebase(rows, chunks, "l_orderkey").select("l_orderkey", "l_linenumber", "start_ms", "end_ms", "rebased")


@query(f"""WITH s AS (SELECT o_custkey, o_orderkey AS scene, o_orderkey % 5 AS number, CASE WHEN o_orderkey % 2 = 0 THEN 'image' ELSE 'video' END AS kind FROM orders),
u AS (SELECT o_custkey, l_linenumber AS number, CASE l_returnflag WHEN 'A' THEN 'image' ELSE 'video' END AS kind, l_partkey AS place, l_orderkey || '_' || l_linenumber AS name FROM {LINES} JOIN orders ON o_orderkey = l_orderkey)
SELECT s.o_custkey, scene, arg_min(name, (place, name)) AS name FROM s JOIN u ON u.o_custkey = s.o_custkey AND u.number = s.number AND u.kind = s.kind GROUP BY ALL""")
def matched_uploads(t: Tables) -> DataFrame:
    """Orders as scenes, lines of a customer's orders as what was uploaded."""
    o, k = t.orders, F.col("o_orderkey")
    s = o.select("o_custkey", k.alias("scene"), (k % 5).alias("scene_number"), F.when(k % 2 == 0, "image").otherwise("video").alias("asset_type"))
    name = F.concat(text_of(F.col("l_orderkey")), F.lit("_"), text_of(F.col("l_linenumber")))
    u = lines(t).join(o.select(k.alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", F.col("l_linenumber").cast("bigint").alias("number"), F.when(F.col("l_returnflag") == "A", "image").otherwise("video").alias("kind"), F.col("l_partkey").alias("place"), name.alias("name"))
    return assets.match_uploads(s, u, "o_custkey", "place")


@query("""WITH k AS (SELECT event_id, user_id % 7 AS language, CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'paused' END AS status FROM events)
SELECT event_id, CASE WHEN language IN (1, 3) AND status = 'processing' THEN 'stop' ELSE 'go on' END AS control, CASE WHEN language IN (1, 3) AND status IN ('queued', 'failed', 'completed') THEN 'canceled' ELSE status END AS status FROM k""")
def canceled_languages(t: Tables) -> DataFrame:
    e = F.col("event_type")
    status = F.when(e == "click", "processing").when(e == "view", "queued").when(e == "purchase", "completed").when(e == "error", "failed").otherwise("paused")
    rows = t.events.select("event_id", (F.col("user_id") % 7).alias("language"), status.alias("status"), F.lit("go on").alias("control"))
    asked = t.nation.where("n_nationkey in (1, 3)").select(F.col("n_nationkey").cast("bigint").alias("language"))
    return jobs.cancel_for(rows, asked, "language", "status", "control").select("event_id", "control", "status")


_STAMP = "lpad(CAST({c} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({c} % 1000 AS VARCHAR), 3, '0')"


@query(f"WITH {CUES_SQL} SELECT conv_id, string_agg('[' || turn || '] ' || {_STAMP.format(c='start_ms')} || ' --> ' || {_STAMP.format(c='end_ms')} || chr(10) || text, chr(10) ORDER BY turn) AS text FROM cues GROUP BY ALL")
def cue_dumps(t: Tables) -> DataFrame:
    return subtitles.render_text(cue_rows(t), "conv_id", "turn")


@query("SELECT conv_id, CAST(turn AS BIGINT) AS position, split_part(text, ' ', 1) AS word, CAST(turn * 0.5 AS DOUBLE) AS start, CAST(turn * 0.5 + 0.25 AS DOUBLE) AS \"end\" FROM conversations WHERE role <> 'system' AND lower(split_part(text, ' ', 1)) NOT IN ('', 'sp', 'sil', '<eps>')")
def textgrid_words(t: Tables) -> DataFrame:
    """Grids of aligned words, written from the first word of each turn and read again; turns of the system are silence, phones are another tier."""
    at = F.col("turn") * 0.5
    word = F.when(F.col("role") == "system", F.lit("sp")).otherwise(F.replace(F.substring_index("text", " ", 1), F.lit('"'), F.lit('""')))
    interval = F.concat(F.lit("xmin = "), text_of(at), F.lit("\n xmax = "), text_of(at + 0.25), F.lit('\n text = "'), word, F.lit('"\n'))
    tier = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", interval.alias("x")))), lambda r: r["x"]), "")
    grid = F.concat(F.lit('item [1]:\n name = "words"\n'), F.col("tier"), F.lit('item [2]:\n name = "phones"\n xmin = 0 xmax = 1 text = "a"\n'))
    grids = t.conversations.groupBy("conv_id").agg(tier.alias("tier")).select("conv_id", grid.alias("text"))
    got = subtitles.parse_textgrid(grids, "conv_id", "text")
    return got.select("conv_id", F.col("position").cast("bigint").alias("position"), "word", "start", "end")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR lang = 'es' THEN text ELSE regexp_replace(text, CASE lang WHEN 'de' THEN 'ung' WHEN 'fr' THEN 'que' ELSE 'tion' END, '$1 ' || lang, 'gi') END AS text FROM documents""")
def replaced_channels(t: Tables) -> DataFrame:
    """A name of each language in all texts, whatever its case, by another; where no other is given or both are alike texts stay."""
    source = F.when(F.col("lang") == "de", "ung").when(F.col("lang") == "fr", "que").otherwise("tion")
    target = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("lang") == "es", " TION ").otherwise(F.concat(F.lit("$1 "), F.col("lang")))
    return t.documents.select("doc_id", languages.replace_channel(F.col("text"), source, target).alias("text"))


@query(f"""WITH RECURSIVE {CUES_SQL}, r AS (SELECT conv_id, turn, n_words AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM cues WHERE n_words > 0),
p AS (SELECT conv_id, turn, n, CAST(1 AS BIGINT) AS chunk, w FROM r WHERE n = 1
  UNION ALL SELECT r.conv_id, r.turn, r.n, CASE WHEN p.w + r.w > 120 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.w + r.w > 120 THEN r.w ELSE p.w + r.w END FROM p JOIN r ON r.conv_id = p.conv_id AND r.n = p.n + 1)
SELECT conv_id, turn, chunk FROM p""")
def packed_words(t: Tables) -> DataFrame:
    return cues.pack_words(t.conversations, "conv_id", "turn", "text", 120).select("conv_id", "turn", "chunk")
