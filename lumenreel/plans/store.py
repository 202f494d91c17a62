"""Queries of the job store over the driver's tables: orders play episodes, line items their languages, events the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.operators import cues, jobs, store
from lumenreel.tables import first_of_key, running

from .registry import Tables, query

NOW = "TIMESTAMP '2024-01-30 00:00:00'"


def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")


#: The states that the event types play.
STATES = {"click": "queued", "view": "processing", "purchase": "completed", "error": "failed", "signup": "canceled"}
STATE_SQL = "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'canceled' END"
RANK_SQL = "CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END"


def job_events(t: Tables) -> DataFrame:
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return t.events.withColumn("status", F.try_element_at(state, F.col("event_type")))


@query("""
WITH l AS (
  SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (l_linestatus = 'O') AS n_open, count(*) FILTER (l_linestatus = 'F') AS n_done,
         count(*) FILTER (l_returnflag = 'R') AS n_returned, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS latest_line, max(l_shipdate) AS latest_ship
  FROM lineitem GROUP BY ALL)
SELECT o_orderkey, c_name, o_orderdate AS updated, coalesce(n_lines, 0) AS n_lines, coalesce(n_open, 0) AS n_open, coalesce(n_done, 0) AS n_done, latest_line, latest_ship,
       CASE WHEN coalesce(n_returned, 0) > 2 THEN 'needs_attention' WHEN coalesce(n_lines, 0) = 0 THEN 'draft' WHEN n_open = 0 THEN 'export' WHEN n_done > 0 THEN 'review' ELSE 'running' END AS board_column
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey""")
def board_flagship(t: Tables) -> DataFrame:
    """The board: episodes with their project, counts of their languages by state, the latest one, and the column of the card."""
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count_if(F.col("l_linestatus") == "F").alias("n_done"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.max_by("l_linenumber", F.struct("l_shipdate", "l_linenumber")).alias("latest_line"), F.max("l_shipdate").alias("latest_ship"),
    )
    o = t.orders.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    column = F.when(n("n_returned") > 2, "needs_attention").when(n("n_lines") == 0, "draft").when(F.col("n_open") == 0, "export").when(F.col("n_done") > 0, "review").otherwise("running")
    return o.select("o_orderkey", "c_name", F.col("o_orderdate").alias("updated"), n("n_lines").alias("n_lines"), n("n_open").alias("n_open"), n("n_done").alias("n_done"), "latest_line", "latest_ship", column.alias("board_column"))


@query("SELECT c_custkey, c_name, count(o_orderkey) AS episodes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def project_episode_counts(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(n, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("episodes"))


@query("SELECT coalesce(o_orderstatus, 'idle') AS status, count(*) AS n, CAST(round_even(100.0 * count(*) / sum(count(*)) OVER (), 0) AS BIGINT) AS percent FROM orders GROUP BY 1")
def status_histogram(t: Tables) -> DataFrame:
    by = t.orders.groupBy(F.coalesce("o_orderstatus", F.lit("idle")).alias("status")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over a row for each status
    return by.select("status", "n", F.bround(100 * F.col("n") / total, 0).cast("bigint").alias("percent"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' AND l_returnflag = 'N'")
def running_with_parent(t: Tables) -> DataFrame:
    open_ = t.lineitem.where("l_linestatus = 'O' AND l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_shipdate")
    return open_.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"), "l_orderkey")


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (
  SELECT 1 FROM events e WHERE e.user_id = o.o_custkey AND e.event_type <> 'signup' AND e.ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 5 DAY)""")
def orphan_anti_join(t: Tables) -> DataFrame:
    """Jobs whose worker hasn't been heard of; a job without a worker is one of them."""
    beats = t.events.select(F.col("user_id").alias("o_custkey"), "ts", F.when(F.col("event_type") == "signup", "stopped").otherwise("live").alias("beat"))
    return store.orphans(t.orders.where("o_orderstatus = 'O'"), beats, "o_custkey", "ts", "beat", now(), 5 * 86400).select("o_orderkey", "o_custkey")


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def in_list_filter(t: Tables) -> DataFrame:
    return store.listing(t.events.select("event_id", "ts", "user_id", "event_type"), ["ts", "event_id"], F.col("event_type").isin("error", "purchase"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def filtered_listing(t: Tables) -> DataFrame:
    return store.listing(t.customer, ["c_name", "c_custkey"], F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT * FROM nation WHERE n_nationkey = 7")
def point_lookup(t: Tables) -> DataFrame:
    return store.lookup(t.nation, n_nationkey=7)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL")
def count_per_key(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return store.latest_by_key(t.events.select("event_id", "ts", "user_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query(f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_id = 77) DESC, {RANK_SQL} DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def best_job_per_group(t: Tables) -> DataFrame:
    return jobs.best(job_events(t), ["user_id"], "event_id", "status", "ts", "ts", F.lit(77)).select("user_id", "event_id", "event_type")


@query(f"""
WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {RANK_SQL} DESC, ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('click', 'view')) WHERE r = 1),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase' AND value > 0) WHERE r = 1)
SELECT coalesce(a.user_id, f.user_id) AS user_id, CASE WHEN f.user_id IS NOT NULL AND (a.user_id IS NULL OR f.ts >= a.ts) THEN f.event_id ELSE a.event_id END AS event_id
FROM a FULL JOIN f ON a.user_id = f.user_id""")
def effective_job(t: Tables) -> DataFrame:
    return jobs.effective(job_events(t), ["user_id"], "event_id", "status", "ts", F.col("value") > 0, F.lit(-1)).select("user_id", "event_id")


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r = 1")
def queue_head_per_priority(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def top_n_recent(t: Tables) -> DataFrame:
    return store.head(t.events.select("event_id", "ts", "event_type"), [F.desc("ts"), F.desc("event_id")], 50)


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def tail_n_per_key(t: Tables) -> DataFrame:
    return store.tail(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["event_id"], 5)


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) > 250 AS expired FROM events")
def keep_newest_n(t: Tables) -> DataFrame:
    return store.expire_old(t.events.select("event_id", "event_type", "ts"), "event_type", ["ts", "event_id"], 250).drop("ts")


@query("SELECT event_id, CASE WHEN event_type = 'error' AND (props IS NULL OR length(props) < 9) THEN '{}' ELSE props END AS props FROM events")
def case_update(t: Tables) -> DataFrame:
    return store.update(t.events.select("event_id", "event_type", "props"), (F.col("event_type") == "error") & (F.col("props").isNull() | (F.length("props") < 9)), props=F.lit("{}")).drop("event_type")


@query(f"SELECT event_id, CASE WHEN event_type = 'view' AND ts < {NOW} - INTERVAL 90 SECOND THEN 'queued' ELSE {STATE_SQL} END AS status, CASE WHEN event_type = 'view' AND ts < {NOW} - INTERVAL 90 SECOND THEN NULL ELSE user_id END AS user_id FROM events")
def stale_requeue(t: Tables) -> DataFrame:
    return store.requeue_stale(job_events(t), "status", "ts", "user_id", now(), 90).select("event_id", "status", "user_id")


@query("""
WITH old AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY ALL), new AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT coalesce(new.user_id, old.user_id) AS user_id, coalesce(new.event_id, old.event_id) AS event_id FROM old FULL JOIN new ON old.user_id = new.user_id""")
def upsert_state(t: Tables) -> DataFrame:
    old = t.events.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return store.upsert(old, t.events.where("event_type = 'error'").select("user_id", "event_id"), ["user_id"], [F.desc("event_id")])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O')")
def insert_if_absent(t: Tables) -> DataFrame:
    new = t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return store.insert_new(t.orders.where("o_orderstatus <> 'O'").select("o_orderkey"), new, ["o_orderkey"])


@query("SELECT coalesce(n_nationkey, r_regionkey) AS key, coalesce(r_name, n_name) AS value FROM nation FULL JOIN region ON n_nationkey = r_regionkey")
def settings_overlay(t: Tables) -> DataFrame:
    return store.overlay(t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value")), "key", "value")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def cascade_delete(t: Tables) -> DataFrame:
    return store.cascade(t.orders.where("o_orderpriority = '1-URGENT'"), t.lineitem.select("l_orderkey", "l_linenumber"), "o_orderkey", "l_orderkey")


@query("SELECT event_id FROM events WHERE NOT (user_id = 3 AND event_type IN ('click', 'view'))")
def delete_in_list(t: Tables) -> DataFrame:
    return store.delete_in(t.events, "event_type", ["click", "view"], F.col("user_id") == 3).select("event_id")


@query("SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(bool_or(l_linenumber = 7), false) AS has_seventh FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING NOT coalesce(bool_or(l_linenumber = 7), false)")
def missing_children(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_linenumber") == 7).alias("s"))
    return t.orders.select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("s", F.lit(False)).alias("has_seventh")).where("not has_seventh")


@query("""
SELECT l_orderkey, l_linenumber, code FROM (
  SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_discount > 0.09 THEN 'discount_too_high' END, CASE WHEN l_quantity > 48 THEN 'too_many' END, CASE WHEN o_orderstatus = 'F' AND l_linestatus = 'O' THEN 'line_open' END], lambda x: x IS NOT NULL)) AS code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def stage_issue_rows(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    return store.issues(rows, ["l_orderkey", "l_linenumber"], {"discount_too_high": F.col("l_discount") > 0.09, "too_many": F.col("l_quantity") > 48, "line_open": (F.col("o_orderstatus") == "F") & (F.col("l_linestatus") == "O")})


@query("SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS done, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS pending FROM lineitem GROUP BY ALL")
def conditional_counts(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(flag == "A").alias("done"), F.count_if(flag == "R").alias("failed"), F.count_if(~flag.isin("A", "R")).alias("pending"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_linestatus = 'O' AND l_quantity > 25 THEN 'info' WHEN l_linestatus = 'O' THEN 'warn' WHEN l_returnflag = 'A' THEN 'success' ELSE 'warn' END AS tone FROM lineitem""")
def overall_tone(t: Tables) -> DataFrame:
    a = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "done").otherwise("pending")
    b = F.when(F.col("l_linestatus") == "F", "done").when(F.col("l_quantity") > 25, "running").otherwise("queued")
    return t.lineitem.select("l_orderkey", "l_linenumber", jobs.tone(a, b).alias("tone"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY ALL")
def p95_nearest_rank(t: Tables) -> DataFrame:
    """The value at rank ceil(0.95 n) of each type; types of any size are numbered in ranges."""
    rows = running(t.events.select("event_type", "value", "event_id").where("value is not null"), ["event_type"], ["value", "event_id"])
    n = t.events.groupBy("event_type").agg(F.count("value").alias("of"), F.count("*").alias("total"))
    return rows.join(n, "event_type").where(F.col("n") == F.ceil(F.lit(95) * F.col("of") / 100)).select("event_type", F.col("value").alias("p95"), F.col("total").alias("n"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS n, (row_number() OVER w - 1) // 8 AS batch FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def batching(t: Tables) -> DataFrame:
    return cues.batches(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 8).drop("o_orderdate")


@query("SELECT o_custkey, o_orderkey, (row_number() OVER w - 1) // 8 + 100 AS batch FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def gap_fill(t: Tables) -> DataFrame:
    """What hasn't come, in batches of its own."""
    missing = t.orders.join(t.lineitem.where("l_linenumber = 5").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_custkey", "o_orderkey")
    return cues.batches(missing, ["o_custkey"], ["o_orderkey"], 8, 100).drop("n")


@query("SELECT user_id, ts AS at FROM events UNION SELECT user_id, ts + INTERVAL 30 SECOND FROM events")
def boundary_union(t: Tables) -> DataFrame:
    e = t.events
    return e.select("user_id", F.col("ts").alias("at")).union(e.select("user_id", F.col("ts") + F.expr("INTERVAL 30 SECOND"))).distinct()


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, round_even(l_quantity / 10, 0), l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def keyed_dedupe(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("q", F.bround(F.col("l_quantity") / 10, 0))
    return first_of_key(rows, ["l_suppkey", "q", "l_returnflag"], [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND ts <= (SELECT max(ts) FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'purchase') THEN 'canceled' ELSE """ + STATE_SQL + """ END AS status FROM events e""")
def cancel_superseded(t: Tables) -> DataFrame:
    return jobs.cancel_superseded(job_events(t), ["user_id"], "status", "ts").select("event_id", "status")


@query(f"""SELECT user_id, CASE WHEN event_type = 'signup' THEN 'stopped' WHEN ts < {NOW} - INTERVAL 2 DAY THEN 'stale' WHEN event_type = 'view' THEN 'busy' ELSE 'idle' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def worker_health(t: Tables) -> DataFrame:
    last = store.latest_by_key(t.events, ["user_id"], ["ts", "event_id"])
    beats = last.withColumns({"status": F.when(F.col("event_type") == "signup", "stopped"), "job": F.when(F.col("event_type") == "view", F.col("event_id"))})
    return jobs.worker_health(beats, "user_id", "ts", "status", "job", now(), 2 * 86400).drop("last_beat")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS slot FROM events WHERE event_type = 'click' QUALIFY slot <= 4")
def claim_queue(t: Tables) -> DataFrame:
    return store.claim(t.events, 4, ["ts", "event_id"], F.col("event_type") == "click", "event_id").withColumn("slot", F.col("slot").cast("bigint"))


@query("SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def merged_counts(t: Tables) -> DataFrame:
    """Maps of counts summed by key."""
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    rows = n.groupBy("user_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "event_type", F.col("n").cast("string")))).alias("c"))
    return rows.select("user_id", F.array_join("c", ",").alias("counts"))


@query("SELECT c_custkey, string_agg(o_orderstatus || o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey DESC) AS orders, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def status_by_parent(t: Tables) -> DataFrame:
    """All children of each parent, newest first, and the latest; parents without any stay."""
    o = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")), False).alias("x"))
    text = F.array_join(F.transform("x", lambda r: F.concat(r["o_orderstatus"], r["o_orderkey"].cast("string"))), ",")
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", text.alias("orders"), F.element_at("x", 1)["o_orderkey"].alias("latest"))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1) ON l_orderkey = o_orderkey")
def strict_assets(t: Tables) -> DataFrame:
    first = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    have = t.orders.join(first, "o_orderkey", "left_semi").select("o_orderkey")
    return store.strict_join(have, first, "o_orderkey", "no line for order")
