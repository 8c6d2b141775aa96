"""Queries on state, queues and governance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.operators import governance as G
from corpusgraph.operators import state as S
from corpusgraph.operators.ranking import latest_per_key, top_per_group
from corpusgraph.plans import query
from corpusgraph.session import ship, table

NOW = "2024-01-31"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("WITH s AS (SELECT user_id, max(ts) AS ts FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id), f AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) SELECT f.user_id, f.ts FROM f LEFT JOIN s USING (user_id) WHERE s.ts IS NULL OR s.ts < f.ts")
def incremental_changed_files(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    return S.changed_files(e.groupBy("user_id").agg(F.max("ts").alias("ts")), e.where(F.col("ts") < _at("2024-01-15")).groupBy("user_id").agg(F.max("ts").alias("ts")), "user_id", "ts").select("user_id", "ts")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def upsert_latest_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    old, new = (latest_per_key(e.where(c), ["user_id"], ["ts", "event_id"]) for c in (F.col("ts") < _at("2024-01-15"), F.col("ts") >= _at("2024-01-15")))
    return S.upsert(old, new, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts")


@query("SELECT user_id, event_type, count(*)::BIGINT AS access_count, max(ts) AS last_accessed FROM events GROUP BY ALL")
def counter_upsert(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))


@query("SELECT user_id, event_type, coalesce(min(event_id) FILTER (event_id % 2 = 0), min(event_id)) AS event_id FROM events GROUP BY ALL")
def insert_if_absent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    none = e.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return S.insert_absent(none, e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"])


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def checkpoint_latest(spark, sf_dir):
    return latest_per_key(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS step FROM events")
def checkpoint_history(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("step"))


@query("SELECT event_type, count(*)::BIGINT AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY event_type")
def checkpoint_cleanup(spark, sf_dir):
    return S.expire(table(spark, sf_dir, "events"), "ts", _at("2024-01-20")).groupBy("event_type").agg(F.count("*").alias("kept"))


@query("""WITH s AS (SELECT user_id AS cluster_id, count(*) AS vector_count, max(ts) AS last_modified FROM events GROUP BY 1), t AS (SELECT user_id AS cluster_id, count(*) AS count_at_sync, max(ts) AS last_sync FROM events WHERE ts < TIMESTAMP '2024-01-30 12:00:00' AND user_id % 5 != 0 GROUP BY 1)
SELECT cluster_id, CASE WHEN last_sync IS NULL AND count_at_sync IS NULL THEN true WHEN last_modified > last_sync THEN true WHEN last_modified IS NULL AND vector_count != count_at_sync THEN true ELSE false END AS changed FROM s LEFT JOIN t USING (cluster_id)""")
def delta_changed_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "cluster_id")
    snap = e.groupBy("cluster_id").agg(F.count("*").alias("vector_count"), F.max("ts").alias("last_modified"))
    sync = e.where((F.col("ts") < _at("2024-01-30 12:00:00")) & (F.col("cluster_id") % 5 != 0)).groupBy("cluster_id").agg(F.count("*").alias("count_at_sync"), F.max("ts").alias("last_sync"))
    return S.changed_clusters(snap, sync)


_CONF = "round((o_totalprice % 1000) / 1000, 6)"


@query(f"SELECT CASE WHEN c < 0.6 THEN 'reject' WHEN c >= 0.9 THEN 'approve' ELSE 'ask' END AS decision, count(*)::BIGINT AS n FROM (SELECT {_CONF} AS c FROM orders) GROUP BY 1")
def gatekeeper_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(G.gate(F.expr(_CONF)).alias("decision")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, {_CONF} AS confidence, CASE WHEN {_CONF} < 0.6 THEN 'reject' WHEN {_CONF} >= 0.9 THEN 'approve' ELSE 'ask' END AS decision FROM orders")
def gatekeeper_decisions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CONF).alias("confidence"), G.gate(F.expr(_CONF)).alias("decision"))


@query(f"""WITH d AS (SELECT o_orderkey, o_custkey, {_CONF} AS c FROM orders WHERE o_orderkey % 7 != 0),
s AS (SELECT c_custkey, c_custkey % 5 AS asks, CASE WHEN c_custkey % 11 = 0 THEN 1 END AS archived, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-01-31' - to_days((c_custkey % 30)::INTEGER) END AS rejected_at FROM customer WHERE c_custkey % 3 != 0)
SELECT CASE WHEN s.c_custkey IS NULL THEN 'new' WHEN archived IS NOT NULL THEN 'archived' WHEN asks >= 3 THEN 'asked_out' WHEN s.c_custkey % 13 = 0 THEN 'snoozed' WHEN rejected_at IS NOT NULL AND TIMESTAMP '2024-01-31' - rejected_at < INTERVAL 14 DAYS THEN 'cooldown' WHEN c < (CASE WHEN rejected_at IS NOT NULL THEN 0.5 END) + 0.15 THEN 'not_risen' ELSE 'ask' END AS reason, count(*)::BIGINT AS n
FROM d LEFT JOIN s ON c_custkey = o_custkey GROUP BY 1""")
def monitor_reconcile(spark, sf_dir):
    """Discoveries without a project (orders whose key isn't divisible by 7) against what was asked before; counts by reason."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.expr(_CONF).alias("c"))
    projects = orders.where("o_orderkey % 7 = 0").select("o_orderkey")
    state = table(spark, sf_dir, "customer").where("c_custkey % 3 != 0").select(
        "c_custkey", F.lit(1).alias("known"), (F.col("c_custkey") % 5).alias("ask_count"), F.when(F.col("c_custkey") % 11 == 0, _at(NOW)).alias("archived_at"), F.when(F.col("c_custkey") % 13 == 0, _at("2024-02-05")).alias("snoozed_until"),
        F.when(F.col("c_custkey") % 4 == 0, _at(NOW) - F.make_dt_interval(days=(F.col("c_custkey") % 30).cast("int"))).alias("rejected_at"), F.when(F.col("c_custkey") % 4 == 0, 0.5).alias("rejected_confidence"),
    )
    both = orders.join(projects, "o_orderkey", "left_anti").join(state, "c_custkey", "left")
    reason = G.ask_reason({c: F.col(c) for c in state.columns}, F.col("c"), _at(NOW))
    return both.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_HOURS = "(date_diff('day', DATE '1996-01-01', o_orderdate::DATE) * 24.0)"


@query(f"""SELECT o_orderkey, round(CASE WHEN {_HOURS} <= 0 THEN 999.0 ELSE (o_orderkey % 40) / {_HOURS} * (o_orderkey % 5 + 1) * left(o_orderpriority, 1)::INTEGER END, 6)::DOUBLE AS pressure FROM orders WHERE o_orderstatus = 'O'""")
def pressure_scores(spark, sf_dir):
    hours = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1996-01-01").cast("date")) * 24.0
    p = G.pressure(F.col("o_orderkey") % 40, hours, F.col("o_orderkey") % 5 + 1, F.substring("o_orderpriority", 1, 1).cast("int"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.round(p, 6).alias("pressure"))


@query("""WITH p AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 6 != 0 THEN o_orderkey % 5 + 1 END AS i, CASE WHEN o_orderkey % 10 != 0 THEN o_orderkey % 4 + 1 END AS u, CASE WHEN o_orderkey % 9 != 0 THEN o_orderdate END AS d FROM orders), s AS (SELECT *, CASE WHEN i IS NULL THEN 1 WHEN u IS NULL THEN 2 WHEN i + u >= 7 AND d IS NULL THEN 3 END AS stage FROM p)
SELECT o_orderkey, stage, row_number() OVER (ORDER BY stage, o_orderdate DESC, o_orderkey)::BIGINT AS place FROM s WHERE stage IS NOT NULL QUALIFY place <= 50""")
def enrichment_queue(spark, sf_dir):
    n = F.col("o_orderkey")
    i, u, d = F.when(n % 6 != 0, n % 5 + 1), F.when(n % 10 != 0, n % 4 + 1), F.when(n % 9 != 0, F.col("o_orderdate"))
    queue = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", G.enrichment_stage(i, u, d).alias("stage")).where("stage is not null")
    first = top_per_group(queue.withColumn("all", F.lit(1)), ["all"], [F.col("stage"), F.desc("o_orderdate"), F.col("o_orderkey")], 50, ["o_orderkey"], rank="place")
    return first.select("o_orderkey", "stage", "place")


@query("SELECT o_orderkey, o_orderdate AS deadline FROM orders WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-01-08' ORDER BY o_orderdate, o_orderkey")
def critical_deadlines(spark, sf_dir):
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > _at("1997-01-01")) & (F.col("o_orderdate") < _at("1997-01-08"))).select("o_orderkey", F.col("o_orderdate").alias("deadline")).orderBy("deadline", "o_orderkey")


_STATUS = {"signup": "pending", "view": "pending", "click": "awaiting_response", "error": "failed", "purchase": "delivered"}


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e FROM events GROUP BY user_id), s(status) AS (VALUES ('pending'), ('awaiting_response'), ('failed'), ('delivered'))
SELECT status, count(user_id)::BIGINT AS n FROM s LEFT JOIN (SELECT user_id, CASE e WHEN 'click' THEN 'awaiting_response' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'delivered' ELSE 'pending' END AS status FROM l) USING (status) GROUP BY status""")
def outbox_status_counts(spark, sf_dir):
    last = latest_per_key(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    status = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("event_type")]
    counts = last.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(s,) for s in dict.fromkeys(_STATUS.values())], "status string").join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT event_id, ts FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 10")
def outbox_pending_fifo(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.col("event_type") == "signup") & (F.col("ts") <= _at("2024-01-20"))).orderBy("ts", "event_id").limit(10).select("event_id", "ts")


@query("SELECT event_id, CASE WHEN event_id % 4 + 1 < 3 THEN ts + to_seconds(60 * pow(2, event_id % 4)) END AS next_attempt FROM events WHERE event_type = 'error'")
def backoff_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", G.backoff(F.col("event_id") % 4, F.col("ts")).alias("next_attempt"))


@query("SELECT user_id, count(*)::BIGINT AS delivered, count(*) < 5 AS allowed FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-30' GROUP BY user_id")
def rate_limit_daily(spark, sf_dir):
    day = table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("ts") >= _at("2024-01-29")) & (F.col("ts") < _at("2024-01-30")))
    return day.groupBy("user_id").agg(F.count("*").alias("delivered")).withColumn("allowed", F.col("delivered") < 5)


@query("SELECT date_trunc('hour', ts) AS hour, count(*)::BIGINT AS sent, count(*) >= 10 AS stop FROM events GROUP BY 1")
def hourly_throttle(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("sent")).withColumn("stop", F.col("sent") >= 10)


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-28' GROUP BY user_id HAVING count(*) = 1")
def reply_single_pending(spark, sf_dir):
    waiting = table(spark, sf_dir, "events").where((F.col("event_type") == "click") & (F.col("ts") >= _at("2024-01-28")))
    return waiting.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n")).where("n = 1").select("user_id", "event_id")


@query("""WITH RECURSIVE n AS (SELECT e.event_id, arg_min(f.event_id, (f.ts, f.event_id)) AS next FROM events e JOIN events f ON f.user_id = e.user_id AND f.ts >= e.ts + INTERVAL 1 HOUR GROUP BY e.event_id),
r AS (SELECT arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id UNION ALL SELECT n.next FROM r JOIN n USING (event_id)) SELECT user_id, ts, event_id FROM r JOIN events USING (event_id)""")
def debounce_events(spark, sf_dir):
    """Events that are processed when each user's next must come an hour or more after the last one processed."""
    from corpusgraph.streaming.debounce import debounce_batch

    ship(spark)
    return debounce_batch(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 3600.0)


@query("""WITH RECURSIVE t AS (SELECT ts, min(event_id) AS event_id FROM events WHERE ts IS NOT NULL GROUP BY ts), b AS (SELECT ts AS at_, event_id, 1 AS p FROM t UNION ALL SELECT ts + INTERVAL 1 DAY, event_id, 0 FROM t), n AS (SELECT event_id, next FROM (SELECT p, event_id, first_value(CASE WHEN p = 1 THEN event_id END IGNORE NULLS) OVER (ORDER BY at_, p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM b) WHERE p = 0 AND next IS NOT NULL),
r AS (SELECT arg_min(event_id, ts) AS event_id FROM t UNION ALL SELECT n.next FROM r JOIN n USING (event_id)) SELECT event_id, ts FROM r JOIN t USING (event_id)""")
def debounce_one_key(spark, sf_dir):
    """All events are of one key, which is processed once a day at most; followed by links, not in one task."""
    from corpusgraph.streaming.debounce import debounce_linked

    e = table(spark, sf_dir, "events").select(F.lit("all").alias("key"), "ts", "event_id")
    return debounce_linked(e, "key", "ts", "event_id", 86400.0).select("event_id", "ts")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def detections_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
