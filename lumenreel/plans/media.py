"""Queries over media time. Turns of conversations play cues: each lasts 60 ms a character and begins where the one before it ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import languages
from lumenreel.functions import text as T
from lumenreel.operators import assets, cues, repair, scenes, segmentation, words
from lumenreel.sources import subtitles
from lumenreel.tables import shared_checkpoint

from .registry import Tables, query

CUES_SQL = r"""
c0 AS (SELECT conv_id, turn, text, 60 * length(text) AS d FROM conversations),
cues AS (SELECT conv_id, turn, text, CAST(sum(d) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) - d AS start_ms, CAST(sum(d) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_ms,
  len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS n_words, length(trim(replace(text, chr(10), ' '))) AS n_chars FROM c0)"""
SCENES_SQL = CUES_SQL + """,
scenes AS (SELECT conv_id, turn // 2 AS scene, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM cues GROUP BY ALL)"""


def cue_rows(t: Tables) -> DataFrame:
    m = cues.measures(F.col("text"))
    rows = t.conversations.select("conv_id", "turn", "text", m["n_words"].alias("n_words"), m["n_chars"].alias("n_chars"))
    return cues.timeline(rows, "conv_id", "turn", (60 * F.length("text")).cast("bigint"))


def scene_rows(t: Tables) -> DataFrame:
    return cue_rows(t).groupBy("conv_id", F.floor(F.col("turn") / 2).alias("scene")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(f"WITH {CUES_SQL} SELECT conv_id, turn, start_ms, end_ms, n_words FROM cues")
def cue_timeline(t: Tables) -> DataFrame:
    return cue_rows(t).select("conv_id", "turn", "start_ms", "end_ms", F.col("n_words").cast("bigint").alias("n_words"))


@query(f"""WITH {CUES_SQL} SELECT conv_id, turn // 3 AS chunk, count(*) AS entries, CAST(sum(n_words) AS BIGINT) AS words, CAST(sum(n_chars) AS BIGINT) AS chars, min(turn) AS first_index, max(turn) AS last_index,
  min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(end_ms) - min(start_ms) AS duration_ms FROM cues GROUP BY ALL""")
def chunk_manifest(t: Tables) -> DataFrame:
    return cues.chunk_summary(cue_rows(t).withColumn("chunk", F.floor(F.col("turn") / 3)), ["conv_id", "chunk"], "turn")


@query(f"""WITH {CUES_SQL}, k AS (SELECT conv_id, turn // 3 AS chunk, count(*) AS entries, sum(n_words) AS words, sum(n_chars) AS chars, max(end_ms) AS e, min(start_ms) AS s FROM cues GROUP BY ALL)
SELECT conv_id, count(*) AS chunks, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(e - s) AS BIGINT) AS duration_ms, max(e) - min(s) AS span_ms FROM k GROUP BY ALL""")
def manifest_totals(t: Tables) -> DataFrame:
    return cues.manifest(chunk_manifest(t), ["conv_id"])


@query(f"""WITH RECURSIVE {CUES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM cues),
p AS (
  SELECT conv_id, turn, n, CAST(1 AS BIGINT) AS chunk, 1 AS entries, n_words AS w, n_chars AS c, start_ms AS s, (n_words > 60 OR n_chars > 400 OR end_ms - start_ms > 30000) AS large FROM r WHERE n = 1
  UNION ALL
  SELECT r.conv_id, r.turn, r.n, CASE WHEN x THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN x THEN 1 ELSE p.entries + 1 END, CASE WHEN x THEN r.n_words ELSE p.w + r.n_words END, CASE WHEN x THEN r.n_chars ELSE p.c + r.n_chars END,
    CASE WHEN x THEN r.start_ms ELSE p.s END, (r.n_words > 60 OR r.n_chars > 400 OR r.end_ms - r.start_ms > 30000)
  FROM p JOIN r ON r.conv_id = p.conv_id AND r.n = p.n + 1, LATERAL (SELECT p.large OR p.entries + 1 > 3 OR p.w + r.n_words > 60 OR p.c + r.n_chars > 400 OR r.end_ms - p.s > 30000 AS x))
SELECT conv_id, turn, chunk, large AS oversized FROM p""")
def greedy_cue_pack(t: Tables) -> DataFrame:
    return cues.pack(cue_rows(t), "conv_id", "turn", 60, 400, 3, 30_000)


@query(f"""WITH {CUES_SQL}, span AS (SELECT conv_id, min(start_ms) AS f, max(end_ms) AS t FROM cues GROUP BY ALL),
w AS (SELECT conv_id, f + k * 20000 AS s, least(t, f + k * 20000 + 24000) AS e FROM span, LATERAL (SELECT unnest(generate_series(0, CASE WHEN t - f <= 24000 THEN 0 ELSE CAST(ceil((t - f - 24000) / 20000.0) AS BIGINT) END)) AS k)),
j AS (SELECT w.conv_id, w.s, w.e, count(*) AS cues, min(turn) AS first_index, max(turn) AS last_index FROM w JOIN cues c ON c.conv_id = w.conv_id AND c.start_ms < w.e AND c.end_ms > w.s GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY s) AS chunk, s AS start_ms, e AS end_ms, cues, first_index, last_index FROM j""")
def hop_windows(t: Tables) -> DataFrame:
    return cues.hop_windows(cue_rows(t), "conv_id", "turn", 24_000, 4_000)


@query(f"WITH {SCENES_SQL} SELECT s.conv_id, s.scene, c.turn FROM scenes s JOIN cues c ON s.conv_id = c.conv_id AND c.start_ms < s.end_ms + 500 AND c.end_ms > s.start_ms - 500")
def scene_cue_overlap(t: Tables) -> DataFrame:
    wide = scene_rows(t).withColumns({"start_ms": F.col("start_ms") - 500, "end_ms": F.col("end_ms") + 500})
    return cues.overlap_join(wide, cue_rows(t).select("conv_id", "turn", "start_ms", "end_ms"), "conv_id", 10_000).select("conv_id", "scene", F.col("r_turn").alias("turn"))


@query(f"""WITH {CUES_SQL}, w AS (SELECT conv_id, turn // 4 AS chunk, min(start_ms) - 2000 AS a, max(end_ms) + 2000 AS b FROM cues GROUP BY ALL),
e AS (SELECT *, a + CASE WHEN chunk > min(chunk) OVER (PARTITION BY conv_id) THEN 6000.0 ELSE 0 END AS lo0, b - CASE WHEN chunk < max(chunk) OVER (PARTITION BY conv_id) THEN 6000.0 ELSE 0 END AS hi0 FROM w),
x AS (SELECT conv_id, chunk, CASE WHEN hi0 <= lo0 THEN a ELSE lo0 END AS lo, CASE WHEN hi0 <= lo0 THEN b ELSE hi0 END AS hi FROM e),
j AS (SELECT c.conv_id, c.turn, c.turn // 4 AS chunk, (c.start_ms + c.end_ms) / 2.0 BETWEEN lo AND hi AS inside, abs((c.start_ms + c.end_ms) / 2.0 - (lo + hi) / 2.0) AS far, c.start_ms FROM cues c JOIN x ON x.conv_id = c.conv_id AND x.chunk = c.turn // 4)
SELECT conv_id, chunk, turn FROM (SELECT *, bool_or(inside) OVER (PARTITION BY conv_id, chunk) AS has_some, row_number() OVER (PARTITION BY conv_id, chunk ORDER BY far, start_ms) AS r FROM j) WHERE inside OR (NOT has_some AND r = 1)""")
def ownership_window(t: Tables) -> DataFrame:
    c = cue_rows(t).withColumn("chunk", F.floor(F.col("turn") / 4))
    w = c.groupBy("conv_id", "chunk").agg((F.min("start_ms") - 2000).alias("from_ms"), (F.max("end_ms") + 2000).alias("to_ms"))
    return scenes.owned(c, w, "conv_id", "chunk", 12_000).select("conv_id", "chunk", "turn")


EVENT_SCENES_SQL = "s AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(value * 100000 AS BIGINT) AS end_ms FROM events)"


def event_scenes(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select("user_id", "event_id", ms.alias("start_ms"), (ms + F.round(F.col("value") * 100000).cast("bigint")).alias("end_ms"))


@query(f"""WITH {EVENT_SCENES_SQL}, p AS (SELECT *, lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS prev FROM s)
SELECT user_id, event_id, array_to_string(list_filter([CASE WHEN end_ms <= start_ms THEN 'ends_before_start' END, CASE WHEN start_ms < prev - 50 THEN 'overlap' END], lambda x: x IS NOT NULL), ',') AS codes,
  array_to_string(list_filter([CASE WHEN end_ms - start_ms < 1000 THEN 'very_short' END, CASE WHEN end_ms - start_ms > 18000 THEN 'very_long' END, CASE WHEN start_ms - prev > 500 THEN 'gap' END, CASE WHEN start_ms - prev > 50 AND start_ms - prev <= 500 THEN 'small_gap' END], lambda x: x IS NOT NULL), ',') AS warnings FROM p""")
def lag_validation(t: Tables) -> DataFrame:
    rows = scenes.checks(event_scenes(t), "user_id", ["start_ms", "event_id"])
    return rows.select("user_id", "event_id", F.array_join("codes", ",").alias("codes"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {EVENT_SCENES_SQL}, p AS (SELECT *, lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS prev FROM s)
SELECT user_id, event_id, CASE WHEN prev - start_ms BETWEEN 1 AND 3600000 THEN prev ELSE start_ms END AS start_ms, coalesce(prev - start_ms BETWEEN 1 AND 3600000, false) AS repaired FROM p""")
def small_overlap_repair(t: Tables) -> DataFrame:
    return scenes.repair_overlaps(event_scenes(t), "user_id", ["start_ms", "event_id"], 3_600_000).select("user_id", "event_id", "start_ms", "repaired")


@query(f"""WITH {SCENES_SQL}, b AS (SELECT conv_id, start_ms AS at_ms FROM cues UNION SELECT conv_id, end_ms FROM cues), q AS (SELECT conv_id, scene, CAST(floor(start_ms * 0.97) AS BIGINT) AS t FROM scenes),
n AS (SELECT q.conv_id, q.scene, q.t, b.at_ms, row_number() OVER (PARTITION BY q.conv_id, q.scene ORDER BY abs(b.at_ms - q.t), b.at_ms) AS r FROM q LEFT JOIN b ON b.conv_id = q.conv_id AND abs(b.at_ms - q.t) <= 500)
SELECT conv_id, scene, t, coalesce(at_ms, t) AS snapped FROM n WHERE r = 1""")
def nearest_snap(t: Tables) -> DataFrame:
    c = cue_rows(t)
    marks = c.select("conv_id", F.col("start_ms").alias("at_ms")).union(c.select("conv_id", "end_ms"))
    q = scene_rows(t).select("conv_id", "scene", F.floor(F.col("start_ms") * F.expr("0.97BD")).cast("bigint").alias("t"))
    return scenes.snap(q, marks, "conv_id", "t")


@query(f"""WITH RECURSIVE {SCENES_SQL}, tot AS (SELECT conv_id, max(end_ms) AS total, max(scene) AS last FROM scenes GROUP BY ALL),
m AS (SELECT s.conv_id, scene, CAST(floor(start_ms * 0.9) AS BIGINT) AS a, CAST(floor(end_ms * 0.9) AS BIGINT) AS b, CAST(floor(total * 0.9) AS BIGINT) AS total, last, row_number() OVER (PARTITION BY s.conv_id ORDER BY scene) AS n FROM scenes s JOIN tot USING (conv_id)),
p AS (SELECT conv_id, scene, n, a AS s, greatest(b, a + 1000) AS e, total, last FROM m WHERE n = 1
  UNION ALL SELECT m.conv_id, m.scene, m.n, greatest(m.a, p.e), greatest(m.b, greatest(m.a, p.e) + 1000), m.total, m.last FROM p JOIN m ON m.conv_id = p.conv_id AND m.n = p.n + 1)
SELECT conv_id, scene, s AS start_ms, CASE WHEN scene = last THEN total ELSE e END AS end_ms FROM p""")
def timeline_map(t: Tables) -> DataFrame:
    s = scene_rows(t)
    total = s.groupBy("conv_id").agg(F.max("end_ms").alias("total_ms"))
    scaled = lambda c: F.floor(F.col(c) * F.expr("0.9BD")).cast("bigint").alias(c)
    return scenes.clamp(s.join(total, "conv_id").select("conv_id", "scene", scaled("start_ms"), scaled("end_ms"), scaled("total_ms")), "conv_id", "scene")


@query(f"""WITH {SCENES_SQL}, n AS (SELECT conv_id, scene, row_number() OVER (PARTITION BY conv_id ORDER BY scene) AS n FROM scenes)
SELECT conv_id, scene, n, 'scene_' || lpad(CAST(n AS VARCHAR), 3, '0') AS scene_id, CASE WHEN n <= 2 THEN 'video' ELSE 'image' END AS asset_type FROM n""")
def first_n_assignment(t: Tables) -> DataFrame:
    return scenes.numbered(scene_rows(t), "conv_id", ["scene"], 2).select("conv_id", "scene", "n", "scene_id", "asset_type")


@query(f"""WITH {CUES_SQL}, s AS (SELECT *, n_chars * 1000.0 / greatest(d0, 10) AS cps FROM (SELECT *, 40 * n_chars + n_words * 10 AS d0 FROM cues))
SELECT conv_id, count(*) AS segments, count(*) FILTER (cps > 18) AS over_limit, count(*) FILTER (cps > 24) AS over_24, count(*) FILTER (cps > 18 AND d0 < 1200) AS short_fast,
  count(*) FILTER (cps > 18 AND d0 >= 1200 AND (n_chars >= 60 OR n_words >= 12)) AS long_text_fast FROM s GROUP BY ALL""")
def density_tiers(t: Tables) -> DataFrame:
    d0 = 40 * F.col("n_chars") + F.col("n_words") * 10
    aggs = segmentation.density(F.col("n_chars") * 1000.0 / F.greatest(d0, F.lit(10)), d0 / 1000, F.col("n_chars"), F.col("n_words"))
    return cue_rows(t).groupBy("conv_id").agg(*[aggs[k].alias(k) for k in ("segments", "over_limit", "over_24", "short_fast", "long_text_fast")])


@query(f"""WITH {CUES_SQL}, k AS (SELECT conv_id, turn // 3 AS cand, count(*) FILTER (n_words > 20) AS slow, max(n_chars) AS worst FROM cues GROUP BY ALL)
SELECT conv_id, cand FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY slow, worst, cand) AS r FROM k) WHERE r = 1""")
def candidate_choice(t: Tables) -> DataFrame:
    k = cue_rows(t).groupBy("conv_id", F.floor(F.col("turn") / 3).alias("cand")).agg(F.count_if(F.col("n_words") > 20).alias("slow"), F.max("n_chars").alias("worst"))
    return segmentation.best_candidate(k, ["conv_id"], "cand", ["slow", "worst"])


@query(f"""WITH {CUES_SQL} SELECT conv_id, turn, turn + 1 AS block, start_ms, end_ms FROM cues""")
def srt_round_trip(t: Tables) -> DataFrame:
    """Cues written as subtitle text and parsed again."""
    one_line = cue_rows(t).withColumn("text", F.concat(F.lit("- "), T.collapse(F.col("text"))))
    docs = subtitles.render_srt(one_line, "conv_id", "turn", F.col("turn"))
    back = subtitles.assert_valid(subtitles.parse_srt(docs, "conv_id", "text"))
    return back.select("conv_id", F.col("index").cast("bigint").alias("turn"), F.col("block").cast("bigint").alias("block"), "start_ms", "end_ms")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS type_number FROM orders) SELECT o_custkey, o_orderkey, type_number FROM s""")
def type_sequence(t: Tables) -> DataFrame:
    return assets.type_sequence(t.orders.withColumnRenamed("o_orderstatus", "asset_type"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", F.col("type_number").cast("bigint").alias("type_number"))


@query()
def char_pack(t: Tables) -> DataFrame:
    return cues.pack_sentences(t.documents, "doc_id", "text", 200)


@query()
def paragraph_pack(t: Tables) -> DataFrame:
    return cues.pack_paragraphs(t.documents, "doc_id", "text", 200, r"\n+")


@query(f"""WITH {CUES_SQL}, r AS (SELECT conv_id, turn, CAST(sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS upto FROM cues) SELECT conv_id, turn, upto FROM r""")
def cumulative_words(t: Tables) -> DataFrame:
    from lumenreel.tables import running

    return running(cue_rows(t).select("conv_id", "turn", "n_words"), ["conv_id"], ["turn"], None, upto=F.col("n_words").cast("bigint")).select("conv_id", "turn", "upto")


@query(f"""WITH RECURSIVE {CUES_SQL}, s AS (SELECT conv_id, turn, greatest(n_words, 1) AS w, row_number() OVER p AS place, sum(greatest(n_words, 1)) OVER p AS upto FROM cues WINDOW p AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id, turn, row_number() OVER p AS k, sum(w) OVER p AS upto FROM (SELECT conv_id, turn // 2 AS turn, sum(1 + length(text) % 97) AS w FROM conversations WHERE conv_id % 2 = 0 GROUP BY ALL UNION ALL SELECT conv_id, 2 * turn + j, 1 + (length(text) + 31 * j) % 97 FROM conversations, range(2) r(j) WHERE conv_id % 2 = 1) WINDOW p AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, count(*) AS n, max(upto) AS words FROM s GROUP BY ALL), u AS (SELECT conv_id, count(*) AS c, max(upto) AS words FROM c GROUP BY ALL),
p AS (SELECT c.conv_id, c.turn, k, n, u.c, (SELECT count(*) FROM s WHERE s.conv_id = c.conv_id AND s.upto < c.upto::DOUBLE / u.words * t.words) + 1 AS proposed FROM c JOIN t USING (conv_id) JOIN u USING (conv_id)),
r AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS turn, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM u
  UNION ALL
  SELECT p.conv_id, p.k, p.turn, r.b, CASE WHEN p.k = p.c OR r.b >= n THEN n ELSE greatest(least(n, r.b + 1), least(proposed, CASE WHEN n - r.b <= p.c - p.k THEN n ELSE n - (p.c - p.k) END)) END
  FROM r JOIN p ON p.conv_id = r.conv_id AND p.k = r.k + 1)
SELECT r.conv_id, s.turn AS scene, r.turn AS chunk FROM r JOIN s ON s.conv_id = r.conv_id AND s.place > r.a AND s.place <= r.b""")
def allocated_scenes(t: Tables) -> DataFrame:
    """Turns as scenes, spread over chunks: one for two turns in one half of the conversations, two for one turn in the other."""
    size, odd = F.length("text"), F.col("conv_id") % 2 == 1
    parts = F.when(odd, F.array(*[F.struct((2 * F.col("turn") + j).cast("bigint").alias("chunk"), (1 + (size + 31 * j) % 97).alias("words")) for j in (0, 1)])).otherwise(F.array(F.struct(F.floor(F.col("turn") / 2).alias("chunk"), (1 + size % 97).alias("words"))))
    chunks = t.conversations.select("conv_id", F.explode(parts).alias("p")).groupBy("conv_id", F.col("p.chunk").alias("chunk")).agg(F.sum("p.words").alias("words"))
    return cues.allocate(chunks, cue_rows(t).select("conv_id", F.col("turn").alias("scene"), "n_words"), "conv_id").select("conv_id", F.col("scene").cast("bigint").alias("scene"), F.col("chunk").cast("bigint").alias("chunk"))


@query()
def tokens(t: Tables) -> DataFrame:
    """Words of all documents with their places."""
    return words.tokenize(t.documents, "doc_id", "text")


def timed_words(t: Tables) -> DataFrame:
    """Words of all turns with times, written once: several steps read them."""
    w = words.tokenize(t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text"), "key", "text")
    return shared_checkpoint(w.withColumns({"start": F.col("begin") * 0.06, "end": F.col("stop") * 0.06, "language": F.lit("en")}))


@query()
def segment_dp(t: Tables) -> DataFrame:
    """The best subtitles of each turn, and how they share the silence between them."""
    return segmentation.share_gaps(segmentation.segment(timed_words(t), "key", "language"), "key")


def hurried_words(t: Tables) -> DataFrame:
    """Words of turns that are said in 48 ms a character, with a breath of 0.3 s after every seventh: too fast to read in places."""
    breath = F.floor(F.col("index") / 7) * 0.3
    return timed_words(t).withColumns({"start": F.col("begin") * 0.048 + breath, "end": F.col("stop") * 0.048 + breath})


@query()
def repaired_segments(t: Tables) -> DataFrame:
    """Hurried turns cut into spans of eight words, repaired where they read too fast."""
    w = hurried_words(t)
    at = F.floor(F.col("index") / 8).cast("int")
    spans = w.groupBy("key", (at + 1).alias("segment")).agg(F.min("index").alias("first"), F.max("index").alias("last"))
    return repair.repaired_segments(w, spans, "key", "language")


@query()
def recut_foci(t: Tables) -> DataFrame:
    """The best cuts around the densest spans of hurried turns."""
    w = hurried_words(t)
    at = F.floor(F.col("index") / 8).cast("int")
    spans = w.groupBy("key", (at + 1).alias("segment")).agg(F.min("index").alias("first"), F.max("index").alias("last"))
    laid = repair.lay_out(w, spans, "key", "language")
    speed = repair.speed(F.col("chars"), F.col("raw_start"), F.col("raw_end"))
    return repair.recut(laid, segmentation.dense(laid.withColumn("speed", speed)).select("key", F.col("segment").alias("focus")), "key")


_NO_END = ", ".join(f"'{w}'" for w in languages.NO_END["en"])
SCORED_SQL = f"""WITH {CUES_SQL}, g AS (SELECT conv_id, turn, n_chars AS chars, n_words AS words, (40 * n_chars + 10 * n_words) / 1000 AS seconds,
  CASE WHEN lower(regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1)) IN ({_NO_END}) THEN 3 ELSE 0 END AS bad, NOT regexp_matches(text, '[.?!;:]$') AS open_end FROM cues),
s AS (SELECT *, chars / greatest(seconds, 0.01) AS v, chars > 84 OR chars > 42 OR seconds > 7 AS beyond FROM g)"""


def scored_cues(t: Tables) -> DataFrame:
    """Cues that are read in 40 ms a character and 10 ms a word, each a segment of one line."""
    bare = F.lower(F.regexp_extract("text", r"([A-Za-z]+)[^A-Za-z]*$", 1))
    rows = cue_rows(t).select("conv_id", F.col("n_chars").alias("chars"), F.col("n_words").alias("words"), F.lit(1).alias("lines"), F.col("n_chars").alias("longest"), "text")
    return rows.select(
        "*", ((40 * F.col("chars") + 10 * F.col("words")) / 1000).alias("seconds"), F.when(bare.isin(*languages.NO_END["en"]), 3).otherwise(0).alias("weak"), (~F.rlike("text", F.lit("[.?!;:]$"))).alias("open_end")
    )


@query(f"""{SCORED_SQL} SELECT conv_id, CAST(count(*) FILTER (beyond) AS BIGINT) AS over_limits, count(*) FILTER (v > 30) AS over_30, count(*) FILTER (v > 24) AS over_24, count(*) FILTER (words < 2 OR chars < 10) AS tiny,
  count(*) FILTER (seconds < 1.2) AS short, round(greatest(18.0, max(v)), 6) AS top_speed, count(*) FILTER (v > 18) AS over_18, round(sum(greatest(v - 18, 0)), 6) AS overflow, CAST(sum(bad) AS BIGINT) AS bad, count(*) AS segments FROM s GROUP BY ALL""")
def repair_scores(t: Tables) -> DataFrame:
    return repair.scores(scored_cues(t), "conv_id", F.col("seconds"), F.col("weak"))


@query(f"""{SCORED_SQL}, a AS (SELECT conv_id, count(*) FILTER (beyond) = 0 AS whole, count(*) FILTER (v > 18) AS over_18, round(greatest(18.0, max(v)), 6) AS top_speed, round(sum(greatest(v - 18, 0)), 6) AS overflow,
  count(*) FILTER (open_end) AS open_ends, count(*) FILTER (seconds < 1.2) AS short, count(*) AS segments, CAST(sum(bad) AS BIGINT) AS bad FROM s GROUP BY ALL)
SELECT conv_id, whole, CASE WHEN whole THEN over_18 END AS over_18, CASE WHEN whole THEN top_speed END AS top_speed, CASE WHEN whole THEN overflow END AS overflow, CASE WHEN whole THEN open_ends END AS open_ends, CASE WHEN whole THEN segments END AS segments, CASE WHEN whole THEN bad END AS bad FROM a""")
def cut_scores(t: Tables) -> DataFrame:
    got = repair.cut_scores(scored_cues(t), "conv_id", F.col("seconds"), F.col("weak"), F.col("open_end"))
    return got.select("conv_id", "whole", *[F.col(f"cut.{c}").alias(c) for c in ("over_18", "top_speed", "overflow", "open_ends", "segments", "bad")])


@query()
def word_align(t: Tables) -> DataFrame:
    """Each turn against what was heard of it: every seventh word is lost and every ninth is cut short."""
    w = timed_words(t)
    heard = w.where("index % 7 <> 3").select("key", F.col("index").alias("position"), F.when(F.col("index") % 9 == 4, F.substring("form", 1, 4)).otherwise(F.col("form")).alias("form"), "start", "end")
    return words.align_report(words.align(w, heard, "key", "language"), "key")


@query("""WITH s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS scene, CASE WHEN o_orderkey % 2 = 0 THEN 'image' ELSE 'video' END AS wanted FROM orders),
f AS (SELECT DISTINCT o_custkey, l_linenumber AS number, l_linenumber || '_' || (l_orderkey % 100) || CASE WHEN l_partkey % 2 = 0 THEN '.png' ELSE '.mp4' END AS name, CASE WHEN l_partkey % 2 = 0 THEN 'image' ELSE 'video' END AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
w AS (SELECT s.o_custkey, scene, name, kind, row_number() OVER (PARTITION BY s.o_custkey, scene ORDER BY kind <> wanted, name) AS n FROM s JOIN f ON f.o_custkey = s.o_custkey AND f.number = s.scene),
p AS (SELECT o_custkey, scene, name, kind FROM w WHERE n = 1),
l AS (SELECT s.o_custkey, s.scene, row_number() OVER (PARTITION BY s.o_custkey ORDER BY s.scene) AS n FROM s ANTI JOIN p ON p.o_custkey = s.o_custkey AND p.scene = s.scene),
r AS (SELECT f.o_custkey, f.name, f.kind, row_number() OVER (PARTITION BY f.o_custkey ORDER BY f.number, f.name) AS n FROM f ANTI JOIN p ON p.o_custkey = f.o_custkey AND p.name = f.name)
SELECT * FROM p UNION ALL SELECT l.o_custkey, l.scene, r.name, r.kind FROM l JOIN r ON r.o_custkey = l.o_custkey AND r.n = l.n""")
def asset_assignment(t: Tables) -> DataFrame:
    """Orders of a customer play scenes, their lines the files, numbered by line: scenes with that place choose, the others take what is left in order."""
    o = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(_by("o_custkey", "o_orderkey")).cast("bigint").alias("scene"))
    s = o.select("o_custkey", "scene", F.lit(None).cast("bigint").alias("scene_number"), F.when(F.col("o_orderkey") % 2 == 0, "image").otherwise("video").alias("asset_type"))
    names = t.lineitem.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    name = F.concat(F.col("l_linenumber").cast("string"), F.lit("_"), (F.col("l_orderkey") % 100).cast("string"), F.when(F.col("l_partkey") % 2 == 0, ".png").otherwise(".mp4"))
    return assets.assign(s, assets.scan_files(names.select("o_custkey", name.alias("name")), "name"), "o_custkey")


def _by(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


@query(f"""WITH {SCENES_SQL}, n AS (SELECT conv_id, turn // 2 AS scene, count(*) AS cues FROM cues GROUP BY ALL)
SELECT conv_id, scene, start_ms, end_ms, end_ms - start_ms AS filled_ms, end_ms - start_ms <= 18000 OR cues = 1 AS whole FROM scenes JOIN n USING (conv_id, scene)""")
def short_scenes(t: Tables) -> DataFrame:
    """Scenes after long ones were cut: parts begin and end where their scene did, without a gap; scenes that need no cut are passed on as they are."""
    parts = scenes.split_long(scene_rows(t), cue_rows(t), "conv_id", "scene")
    ends = parts.groupBy("conv_id", "scene").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("filled_ms"), (F.count("*") == 1).alias("whole"))
    return ends.select("conv_id", "scene", "start_ms", "end_ms", "filled_ms", "whole")


@query()
def split_scenes(t: Tables) -> DataFrame:
    whole = cue_rows(t).groupBy("conv_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).withColumn("scene", F.lit(1))
    return scenes.split_long(whole, cue_rows(t), "conv_id", "scene")


@query(f"""WITH {SCENES_SQL} SELECT conv_id, count(*) AS scenes, 0 AS errors, 'valid' AS status, max(end_ms) - min(start_ms) AS total_ms FROM scenes GROUP BY ALL""")
def timeline_report(t: Tables) -> DataFrame:
    s = scenes.checks(scene_rows(t), "conv_id", ["scene"])
    return scenes.report(s, "conv_id", "scene", cue_rows(t)).select("conv_id", "scenes", F.col("errors").cast("int").alias("errors"), "status", "total_ms")


