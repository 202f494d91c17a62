"""Queries of text functions and quality checks over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import languages, times
from lumenreel.functions import text as T
from lumenreel.operators import entities, profiles, quality

from .registry import Tables, query

WS = r"regexp_replace({c}, '\s+', ' ', 'g')"
LOW = "lower(trim(" + WS.format(c="text") + "))"
WORDS = "list_filter(string_split(trim(" + WS.format(c="text") + "), ' '), lambda x: x <> '')"


@query(f"SELECT doc_id, len({WORDS}) AS n_words, sha256({LOW}) AS hash, length(text) AS n_chars FROM documents")
def sha_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("n_words"), T.content_hash(T.compare_form(F.col("text"))).alias("hash"), F.length("text").cast("bigint").alias("n_chars"))


@query(f"SELECT conv_id, turn, length(trim(replace(text, chr(10), ' '))) AS n_chars, len({WORDS}) AS n_words, greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS n_lines FROM conversations")
def cue_measures(t: Tables) -> DataFrame:
    from lumenreel.operators.cues import measures

    return t.conversations.select("conv_id", "turn", *[c.cast("bigint").alias(n) for n, c in measures(F.col("text")).items()])


@query("""SELECT c_custkey, left(c_name, 4) || repeat('*', greatest(length(c_name) - 8, 4)) || right(c_name, 4) AS masked FROM customer WHERE length(c_name) > 8
UNION ALL SELECT c_custkey, repeat('*', length(c_name)) FROM customer WHERE length(c_name) <= 8""")
def masking(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.mask_secret(F.col("c_name")).alias("masked"))


@query("""SELECT page_id, try_cast(nullif(regexp_extract(url, '\\((\\d+)\\)', 1), '') AS BIGINT) AS bracket, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS suffix,
  coalesce(nullif(trim(lower(regexp_replace(url, '[^a-zA-Z0-9]+', '-', 'g')), '-'), ''), 'job') AS slug FROM pages""")
def file_names(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", F.nullif(F.regexp_extract(u, T.NUMBER_PLACES[3], 1), F.lit("")).try_cast("bigint").alias("bracket"), T.suffix(u).alias("suffix"), T.slug(u).alias("slug"))


@query("""
WITH n AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'prompt ' || o_orderkey WHEN 1 THEN 'Scene_' || o_orderkey || ' (2)' WHEN 2 THEN 'asset ' || o_orderkey WHEN 3 THEN 'x(' || o_orderkey || ')' WHEN 4 THEN o_orderkey || '_a' ELSE 'none' END
  || CASE o_orderkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.dat' ELSE '' END AS name FROM orders)
SELECT o_orderkey, name, CASE WHEN o_orderkey % 6 < 5 THEN o_orderkey END AS number, CASE o_orderkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'binary' ELSE '' END AS kind FROM n""")
def filename_number(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    s = k.cast("string")
    stem = F.when(k % 6 == 0, F.concat(F.lit("prompt "), s)).when(k % 6 == 1, F.concat(F.lit("Scene_"), s, F.lit(" (2)"))).when(k % 6 == 2, F.concat(F.lit("asset "), s)).when(k % 6 == 3, F.concat(F.lit("x("), s, F.lit(")"))).when(k % 6 == 4, F.concat(s, F.lit("_a"))).otherwise("none")
    name = F.concat(stem, F.when(k % 4 == 0, ".PNG").when(k % 4 == 1, ".mp4").when(k % 4 == 2, ".dat").otherwise(""))
    return t.orders.select("o_orderkey", name.alias("name"), T.number_in_name(name).alias("number"), T.suffix_class(name).alias("kind"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("""SELECT event_id, CASE WHEN k BETWEEN 10 AND 80 THEN k WHEN k < 10 THEN 10 WHEN k > 80 THEN 80 ELSE 30 END AS top_k FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def voice_limits(t: Tables) -> DataFrame:
    v = profiles.voice_settings(F.regexp_replace("props", '"k"', '"top_k"'))
    return t.events.select("event_id", v["top_k"].alias("top_k"))


LANG_SQL = "CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' ELSE 'English' END"


@query(f"SELECT doc_id, coalesce(lang, 'en') AS code, {LANG_SQL} AS language_name FROM documents")
def language_lookup(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", languages.language_code(F.upper("lang")).alias("code"), languages.pack_code(F.upper("lang")).alias("pack"))
    return d.join(F.broadcast(languages.packs(t.spark)).select(F.col("code").alias("pack"), "language_name"), "pack").select("doc_id", "code", "language_name")  # a row for each language


def _category_sql() -> str:
    cases = []
    for name, ways in quality.ISSUE_RULES:
        test = " OR ".join("(" + " AND ".join(f"contains(t, '{f}')" for f in way) + ")" for way in ways)
        cases.append(f"WHEN {test} THEN '{name}'")
    return f"SELECT doc_id, CASE WHEN t = '' THEN 'provider_error' {' '.join(cases)} ELSE 'faithfulness' END AS category FROM (SELECT doc_id, {LOW} AS t FROM documents)"


@query(_category_sql())
def issue_category(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", quality.issue_category(F.col("text")).alias("category"))


_LEAKS = "|".join(languages.ENGLISH_INVITES)
_WORDINGS = " OR ".join(f"(lang = '{code}' AND regexp_matches(t, '(?i){pattern}'))" for code, rules in languages.BAD_WORDINGS.items() for pattern, _ in rules)


@query(rf"""
WITH d AS (SELECT doc_id, lang, trim(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(t, '\s+', ' ', 'g'), ' ')), '()[]{{}}<>"''.,;:!?') AS w FROM d),
g AS (SELECT DISTINCT doc_id FROM w WHERE length(w) >= 6 AND (regexp_matches(regexp_replace(w, '[^A-Za-z]', '', 'g'), '(?i)^[bcdfghjklmnpqrstvwxyz]{{8,}}$') OR len(list_filter(range(1, length(w) - 4), lambda i: substr(w, i, 6) = repeat(substr(w, i, 1), 6))) > 0)),
f AS (SELECT doc_id, t, lang <> 'en' AND regexp_matches(t, '(?i)(?:{_LEAKS})') AS leak, {_WORDINGS} AS wording, regexp_matches(t, '\p{{Nd}}') AS digits, g.doc_id IS NOT NULL AS odd FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN t = '' THEN 'empty_output' ELSE array_to_string(list_filter([CASE WHEN leak THEN 'english_cta_leak' END, CASE WHEN wording THEN 'language_rule_violation' END, CASE WHEN digits THEN 'digits_present' END, CASE WHEN odd THEN 'gibberish_output' END], lambda x: x IS NOT NULL), ',') END AS codes FROM f""")
def doc_findings(t: Tables) -> DataFrame:
    """Categories of findings of each document."""
    codes = F.array_distinct(F.transform(quality.findings(F.col("text"), F.col("lang")), lambda f: f["category"]))
    return t.documents.select("doc_id", F.array_join(codes, ",").alias("codes"))


@query(rf"""
WITH l AS (SELECT doc_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents)
SELECT doc_id, sha256(line) AS line, count(*) AS times, min(place) AS first_at FROM l WHERE len(string_split(line, ' ')) >= 6 GROUP BY doc_id, line HAVING count(*) > 1""")
def doc_dup_lines(t: Tables) -> DataFrame:
    rows = quality.repeated_lines(t.documents, "doc_id", "text")
    return rows.select("doc_id", F.sha2("line", 256).alias("line"), "times", F.col("first_at").cast("bigint").alias("first_at"))


@query(f"""
WITH d AS (SELECT doc_id, ' ' || {LOW} || ' ' AS t FROM documents), b AS (SELECT item_id, {LOW} AS t FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, ' ' || b.t || ' ') WHERE len(string_split(b.t, ' ')) >= 4""")
def benchmark_leak(t: Tables) -> DataFrame:
    return quality.contained(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query()
def sensitive_terms(t: Tables) -> DataFrame:
    """All terms of all documents; word boundaries beyond ASCII have no form in the oracle's patterns, so tests hold it against a plain scan."""
    return t.documents.select("doc_id", quality.sensitive_terms(F.col("text")).alias("terms"))


@query(rf"""SELECT doc_id, CASE WHEN length(c) <= 180 THEN c ELSE rtrim(left(c, 177)) || '...' END AS excerpt FROM (SELECT doc_id, trim({WS.format(c="text")}) AS c FROM documents)""")
def excerpts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("""SELECT p_partkey, CASE WHEN abs(b - a) <= 0.05 THEN 'direct' WHEN a < b AND b / a <= 1.35 THEN 'slow' WHEN a < b THEN 'freeze' WHEN a / b <= 1.15 THEN 'fast' ELSE 'trim' END AS plan FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, 10 + p_partkey % 30.0 AS b FROM part)""")
def retime_plan(t: Tables) -> DataFrame:
    plan = times.retime_plan(F.col("p_size").cast("double"), 10.0 + F.col("p_partkey") % 30)
    label = plan["label"]
    return t.part.select("p_partkey", F.when(F.endswith(label, F.lit("freeze")), "freeze").when(F.startswith(label, F.lit("slow")), "slow").when(F.startswith(label, F.lit("speed")), "fast").otherwise(label).alias("plan"))


@query("""SELECT event_id, lpad(CAST(ms // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(ms // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS stamp, ms AS back
FROM (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS ms FROM events)""")
def srt_timestamp(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    stamp = times.format_stamp(ms)
    return t.events.select("event_id", stamp.alias("stamp"), times.parse_stamp(stamp).alias("back"))


@query("""SELECT o_orderkey, p AS current, 12 AS total, CAST(round_even(p * 100.0 / 12, 0) AS INTEGER) AS percent FROM (SELECT o_orderkey, CAST(o_orderkey % 12 + 1 AS INTEGER) AS p FROM orders)""")
def progress_percent(t: Tables) -> DataFrame:
    p = T.progress(F.concat(F.lit("Chunk  "), (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit(" / 12")))
    return t.orders.select("o_orderkey", p["current"].alias("current"), p["total"].alias("total"), T.percent_done(p["current"], p["total"]).alias("percent"))


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'small r')""")
def model_search(t: Tables) -> DataFrame:
    return profiles.search(t.part, ["p_name", "p_brand", "p_type"], " Small R ").select("p_partkey", "p_name")


@query(r"""SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}_]+', '', 'g')) AS form FROM documents""")
def token_form(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.token(F.col("text")).alias("form"))


@query(r"""
WITH a AS (SELECT item_id AS entity, lower(regexp_extract(text, '[\p{L}\p{M}\p{N}_]+')) AS alias FROM benchmark),
w AS (SELECT page_id, unnest(string_split(trim(regexp_replace(lower(html), '[^\p{L}\p{N}\p{M}_]+', ' ', 'g')), ' ')) AS word FROM pages)
SELECT DISTINCT page_id, entity FROM w JOIN a ON word = alias""")
def entity_mentions(t: Tables) -> DataFrame:
    """Pages that hold the first word of a benchmark item."""
    names = t.benchmark.select(F.col("item_id").alias("entity"), F.regexp_extract("text", r"(?U)\w+", 0).alias("alias"))
    return entities.mentions(t.pages, "page_id", "html", names).select("page_id", "entity")
