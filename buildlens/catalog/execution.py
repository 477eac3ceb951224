"""Registered queries for execution logs, workers and connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlens.catalog.sqltext import with_ctes
from buildlens.functions import exprs as X
from buildlens.operators import cache as C
from buildlens.operators import execution as E
from buildlens.operators import workers as W
from buildlens.plans import standins as D

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def us(df, *columns):
    """Timestamps as microseconds."""
    return df.withColumns({c: F.unix_micros(c) for c in columns})


@query(
    "queue_class",
    "SELECT l_orderkey AS operation_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS input_bytes, "
    "CASE WHEN sum(CAST(round(l_extendedprice * 100) AS BIGINT)) < 1048576 THEN 'fast' "
    "WHEN sum(CAST(round(l_extendedprice * 100) AS BIGINT)) < 20971520 THEN 'medium' ELSE 'slow' END AS queue "
    "FROM lineitem GROUP BY 1",
)
def _(s, d):
    li = D.table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("operation_id"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("size_bytes")
    )
    return E.queue_class(li, medium_below=20 * E.MIB)


@query(
    "stage_mix",
    with_ctes("trans", "SELECT CAST(CASE stage WHEN 'Queued' THEN 2 WHEN 'Failed' THEN 4 ELSE 3 END AS INTEGER) AS stage_code, "
              "CASE stage WHEN 'Queued' THEN 'QUEUED' WHEN 'Failed' THEN 'COMPLETED' ELSE 'EXECUTING' END AS stage_name, "
              "count(*) AS entries FROM trans GROUP BY 1, 2"),
)
def _(s, d):
    return E.stage_mix(D.transitions(s, d))


def executions(s, d):
    li = D.table(s, d, "lineitem")
    no_result = (F.col("l_linestatus") == "O") & (F.col("l_tax") == 0)
    return li.select(
        F.col("l_suppkey").alias("worker_id"),
        F.when(no_result, None).when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("exit_code"),
        (F.col("l_discount") == 0).alias("cached"),
    )


EXECUTIONS = (
    "SELECT l_suppkey AS worker_id, CASE WHEN l_linestatus = 'O' AND l_tax = 0 THEN NULL WHEN l_returnflag = 'R' THEN 1 "
    "ELSE 0 END AS exit_code, l_discount = 0 AS cached FROM lineitem"
)


@query(
    "result_mix",
    f"SELECT CAST(CASE WHEN exit_code IS NULL THEN 2 ELSE exit_code END AS INTEGER) AS status, CASE WHEN cached THEN 'cached' "
    f"ELSE 'executed' END AS origin, count(*) AS executions FROM ({EXECUTIONS}) GROUP BY 1, 2",
)
def _(s, d):
    return E.result_mix(executions(s, d))


@query(
    "resolve_actions",
    "SELECT l_orderkey AS request_id, l_linenumber AS line, l_partkey AS part, CASE WHEN l_linenumber = 7 THEN NULL "
    "ELSE l_partkey END AS action_hash, r AS resolution, CASE WHEN r = 'resolved' THEN CASE WHEN p_size % 5 > 0 THEN p_size % 5 "
    "ELSE 300 END END AS timeout_seconds, CASE WHEN r = 'resolved' THEN CASE WHEN s_nationkey % 2 = 0 THEN 'out/' || s_name "
    "ELSE 'file/' || s_name END END AS output_files, CASE WHEN r = 'resolved' THEN CASE WHEN s_nationkey % 2 = 0 THEN '' "
    "ELSE 'dir/' || s_name END END AS output_directories FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 'missing digest' "
    "WHEN p_partkey IS NULL THEN 'action not found' WHEN p_size % 10 = 0 THEN 'command missing' WHEN s_suppkey IS NULL "
    "THEN 'command not found' ELSE 'resolved' END AS r FROM lineitem LEFT JOIN (SELECT p_size, CASE WHEN p_size % 7 = 3 THEN "
    "-p_partkey ELSE p_partkey END AS p_partkey FROM part) ON p_partkey = l_partkey LEFT JOIN (SELECT s_name, s_nationkey, CASE WHEN "
    "s_suppkey % 4 = 1 THEN -s_suppkey ELSE s_suppkey END AS s_suppkey FROM supplier) ON s_suppkey = p_size - 1)",
)
def _(s, d):
    li = D.table(s, d, "lineitem")
    requests = li.select(
        F.struct(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")).alias(
            "request_id"
        ),
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("action_hash"),
    )
    # some actions and commands are stored under a digest that nobody asks for
    actions = D.table(s, d, "part").select(
        F.when(F.col("p_size") % 7 == 3, -F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("action_hash"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("bigint") - 1).alias("command_hash"),
        (F.col("p_size") % 5).alias("timeout_seconds"),
    )
    name = F.col("s_name")
    one = lambda prefix: F.array(F.concat(F.lit(prefix), name))
    commands = D.table(s, d, "supplier").select(
        F.when(F.col("s_suppkey") % 4 == 1, -F.col("s_suppkey")).otherwise(F.col("s_suppkey")).cast("bigint").alias("command_hash"),
        F.when(F.col("s_nationkey") % 2 == 0, one("out/")).otherwise(F.array().cast("array<string>")).alias("output_paths"),
        one("file/").alias("output_files"),
        one("dir/").alias("output_directories"),
    )
    out = E.resolve_actions(requests, actions, commands)
    return out.select(
        F.col("request_id.request").alias("request_id"),
        "request_id.line",
        "request_id.part",
        "action_hash",
        "resolution",
        "timeout_seconds",
        F.array_join("output_files", ",").alias("output_files"),
        F.array_join("output_directories", ",").alias("output_directories"),
    )


@query(
    "result_join",
    "SELECT o_orderkey AS operation_id, execution_id, CASE WHEN o_orderkey IS NULL THEN 'unmatched result' WHEN execution_id IS "
    "NULL THEN 'no result' WHEN exit_code = 0 THEN 'completed' ELSE 'failed' END AS outcome FROM (SELECT CASE WHEN "
    "o_orderstatus = 'O' THEN -o_orderkey ELSE o_orderkey END AS o_orderkey FROM orders) FULL JOIN (SELECT CASE WHEN c_nationkey = 3 THEN 'job-' ELSE 'exec-' END || c_custkey AS execution_id, "
    "CASE WHEN c_nationkey <> 3 THEN c_custkey END AS n, c_nationkey % 3 AS exit_code FROM customer) ON n = o_orderkey",
)
def _(s, d):
    # no result knows an open order by the number that its operation has
    key = F.when(F.col("o_orderstatus") == "O", -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    operations = D.table(s, d, "orders").select(key.alias("operation_id"))
    prefix = F.when(F.col("c_nationkey") == 3, "job-").otherwise("exec-")
    results = D.table(s, d, "customer").select(
        F.concat(prefix, F.col("c_custkey").cast("string")).alias("execution_id"), (F.col("c_nationkey") % 3).alias("exit_code")
    )
    return E.result_join(operations, results)


@query(
    "version_range_join",
    "SELECT p_partkey, text, CASE WHEN major >= 9 THEN 'v9' WHEN major = 8 THEN 'v8' WHEN major = 7 THEN 'v7' ELSE 'default' "
    "END AS handler, CASE WHEN major = 7 THEN '2.3' ELSE '2.4' END AS protocol FROM (SELECT p_partkey, "
    "regexp_extract(p_brand, '([0-9]+)', 1) || '.' || p_size AS text, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) "
    "AS major FROM part)",
)
def _(s, d):
    text = F.concat(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("."), F.col("p_size").cast("string"))
    versions = D.table(s, d, "part").select("p_partkey", text.alias("text")).withColumn("version", X.version_of(F.col("text")))
    return E.version_range_join(versions).drop("version")


@query(
    "stage_durations",
    with_ctes("trans", "SELECT op AS operation_id, seq, stage, us AS ts, lead(us) OVER (PARTITION BY op ORDER BY us, seq) - us "
              "AS duration_us FROM trans"),
)
def _(s, d):
    return us(E.stage_durations(D.transitions(s, d)), "ts")


@query(
    "operation_elapsed",
    with_ctes("trans", "SELECT op AS operation_id, max(us) - min(us) AS elapsed_us, count(*) AS entries FROM trans GROUP BY op"),
)
def _(s, d):
    return E.operation_elapsed(D.transitions(s, d))


LEGAL = (
    "SELECT * FROM (VALUES ('Unknown', 'CacheCheck'), ('Unknown', 'Failed'), ('CacheCheck', 'Queued'), "
    "('CacheCheck', 'Completed'), ('CacheCheck', 'Failed'), ('Queued', 'Assigned'), ('Queued', 'Failed'), "
    "('Assigned', 'Downloading'), ('Assigned', 'Completed'), ('Assigned', 'Failed'), ('Downloading', 'Executing'), "
    "('Downloading', 'Completed'), ('Downloading', 'Failed'), ('Executing', 'Uploading'), ('Executing', 'Completed'), "
    "('Executing', 'Failed'), ('Uploading', 'Completed'), ('Uploading', 'Failed')) t(a, b)"
)


@query(
    "transition_audit",
    with_ctes(
        "trans",
        "SELECT op AS operation_id, seq, us AS ts, a AS from_stage, stage AS to_stage FROM (SELECT *, coalesce(lag(stage) OVER "
        "(PARTITION BY op ORDER BY us, seq), 'CacheCheck') AS a FROM trans) t WHERE NOT EXISTS (SELECT 1 FROM legal l WHERE "
        "l.a = t.a AND l.b = t.stage)",
        legal=LEGAL,
    ),
)
def _(s, d):
    return us(E.transition_audit(D.transitions(s, d)), "ts")


REPLAY = with_ctes(
    "trans",
    "SELECT op AS operation_id, step, us AS ts, seq, stage FROM r WHERE step > 0",
    legal=LEGAL,
    r="SELECT op, 0 AS step, CAST(-1 AS BIGINT) AS us, CAST(-1 AS BIGINT) AS seq, 'CacheCheck' AS stage FROM trans GROUP BY op "
    "UNION ALL SELECT op, step, us, seq, stage FROM (SELECT t.op, r.step + 1 AS step, t.us, t.seq, t.stage, row_number() OVER "
    "(PARTITION BY t.op ORDER BY t.us, t.seq) AS rn FROM r JOIN trans t ON t.op = r.op AND (t.us > r.us OR (t.us = r.us AND "
    "t.seq > r.seq)) JOIN legal l ON l.a = r.stage AND l.b = t.stage) WHERE rn = 1",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("transition_replay", REPLAY)
def _(s, d):
    return us(E.transition_replay(D.transitions(s, d)), "ts")


@query(
    "history_cap",
    with_ctes("trans", "SELECT op AS operation_id, seq, us AS ts, stage, CAST(rn AS INTEGER) AS recency FROM (SELECT *, row_number() "
              "OVER (PARTITION BY op ORDER BY us DESC, seq DESC) AS rn FROM trans) WHERE rn <= 100"),
)
def _(s, d):
    return us(E.history_cap(D.transitions(s, d)), "ts")


@query(
    "stuck_operations",
    with_ctes(
        "trans",
        "SELECT *, silent_us >= 60000000 AS not_alive, silent_us > 300000000 AS dead, age_us > 3600000000 AS stale FROM (SELECT op "
        "AS operation_id, arg_max(stage, seq) AS stage, (SELECT max(us) FROM trans) - max(us) AS silent_us, (SELECT max(us) FROM "
        "trans) - min(us) AS age_us FROM trans GROUP BY op) WHERE stage <> 'Failed' AND (silent_us >= 60000000 OR age_us > "
        "3600000000)",
    ),
)
def _(s, d):
    log = D.transitions(s, d)
    now = log.agg(F.unix_micros(F.max("ts"))).first()[0]
    return E.stuck_operations(log, now)


MERGE = with_ctes(
    "ev",
    "SELECT q.seq, q.hash, q.enq AS enqueued_us, (SELECT max(r.seq) FROM r WHERE r.hash = q.hash AND r.seq <= q.seq) AS "
    "merged_into, q.seq IN (SELECT seq FROM r) AS leader FROM q",
    q="SELECT seq, k AS hash, us AS enq, us + CAST(floor(value) AS BIGINT) * 60000000 AS done FROM ev",
    r="SELECT * FROM (SELECT hash, min(seq) AS seq FROM q GROUP BY hash) JOIN q USING (hash, seq) UNION ALL SELECT hash, seq, enq, "
    "done FROM (SELECT q.hash, q.seq, q.enq, q.done, row_number() OVER (PARTITION BY q.hash ORDER BY q.enq, q.seq) AS rn FROM r "
    "JOIN q ON q.hash = r.hash AND q.enq >= r.done AND q.seq > r.seq) WHERE rn = 1",
).replace("WITH ", "WITH RECURSIVE ", 1)


def merge_requests(s, d):
    e = D.event_log(s, d)
    at = F.unix_micros("ts")
    return e.select(
        F.col("k").alias("hash"),
        F.col("event_id").alias("seq"),
        at.alias("enqueued_us"),
        (at + F.floor("value").cast("bigint") * 60_000_000).alias("completed_us"),
    )


@query("merge_inflight", MERGE)
def _(s, d):
    return E.merge_inflight(merge_requests(s, d))


@query(
    "merge_ratio",
    f"SELECT hash, count(*) AS requests, count(*) FILTER (WHERE leader) AS leaders, 1 - count(*) FILTER (WHERE leader)::DOUBLE / "
    f"count(*) AS merge_ratio FROM ({MERGE}) GROUP BY hash",
)
def _(s, d):
    return E.merge_ratio(E.merge_inflight(merge_requests(s, d)))


QUEUE_AT = 1704067200000000 + 15 * 86400 * 1000000
QUEUES = (
    f"SELECT count(*) FILTER (WHERE w AND q = 'fast') AS fast_queued, count(*) FILTER (WHERE w AND q = 'medium') AS medium_queued, "
    "count(*) FILTER (WHERE w AND q = 'slow') AS slow_queued, count(*) FILTER (WHERE f) AS in_flight FROM (SELECT "
    f"us <= {QUEUE_AT} AND {QUEUE_AT} < us + k * 60000000 AS w, us <= {QUEUE_AT} AND {QUEUE_AT} < us + (k + value) * 60000000 AS f, "
    "CASE k % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'medium' ELSE 'slow' END AS q FROM ev)"
)


def queues(s, d):
    e = D.event_log(s, d)
    at = F.unix_micros("ts")
    items = e.select(
        at.alias("enqueued_us"),
        (at + F.col("k") * 60_000_000).alias("dequeued_us"),
        (at + (F.col("k") + F.col("value")) * 60_000_000).alias("completed_us"),
        F.when(F.col("k") % 3 == 0, "fast").when(F.col("k") % 3 == 1, "medium").otherwise("slow").alias("queue"),
    )
    return E.queue_stats(items, QUEUE_AT)


@query("queue_stats", with_ctes("ev", QUEUES))
def _(s, d):
    return queues(s, d)


LATEST = (
    "SELECT user_id AS worker_id, CASE arg_max(event_type, seq) WHEN 'view' THEN 'idle' WHEN 'error' THEN 'unhealthy' ELSE 'busy' "
    "END AS state, max(us) AS heartbeat FROM ev GROUP BY user_id"
)
WORKER_STATS = (
    "SELECT *, greatest(busy - idle, 0) AS queue_depth FROM (SELECT count(*) FILTER (WHERE state = 'idle') AS idle, count(*) FILTER "
    "(WHERE state = 'busy') AS busy, count(*) FILTER (WHERE state = 'unhealthy') AS unhealthy, count(*) AS total FROM latest)"
)


@query("worker_stats", with_ctes("ev", WORKER_STATS, latest=LATEST))
def _(s, d):
    return W.worker_stats(D.worker_states(s, d))


@query(
    "active_executions",
    with_ctes(
        "ev",
        "SELECT metric, value FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, k FROM ev WHERE event_type = 'click') a "
        "WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.k = a.k)) AS "
        "active_executions, ws.*, qs.* FROM ws, qs) UNPIVOT (value FOR metric IN (active_executions, idle, busy, unhealthy, total, "
        "queue_depth, fast_queued, medium_queued, slow_queued, in_flight))",
        latest=LATEST,
        ws=WORKER_STATS,
        qs=QUEUES,
    ),
)
def _(s, d):
    e = D.event_log(s, d).withColumn("execution_id", F.struct("user_id", "k"))
    started, finished = e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'")
    return E.active_executions(started, finished, W.worker_stats(D.worker_states(s, d)), queues(s, d))


@query(
    "pool_stats",
    with_ctes(
        "ev",
        "SELECT count(*) FILTER (WHERE state = 'idle') AS available_workers, count(*) FILTER (WHERE state = 'busy') AS busy_workers, "
        "(SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS pending_actions, count(*) FILTER (WHERE state <> 'unhealthy') "
        "AS total_workers FROM latest",
        latest=LATEST,
    ),
)
def _(s, d):
    return W.pool_stats(D.worker_states(s, d), D.table(s, d, "orders").filter("o_orderstatus = 'O'"))


@query("workers_by_type", "SELECT s_suppkey % 3 AS worker_type, count(*) AS workers FROM supplier GROUP BY 1")
def _(s, d):
    return W.workers_by_type(D.table(s, d, "supplier").select((F.col("s_suppkey") % 3).alias("worker_type")))


@query(
    "oldest_idle_worker",
    with_ctes("ev", "SELECT arg_min(worker_id, heartbeat) AS worker_id FROM latest WHERE state = 'idle'", latest=LATEST),
)
def _(s, d):
    return W.oldest_idle_worker(D.worker_states(s, d))


def fleet(s, d):
    """Suppliers as workers: labels are nation, region and a size class; half of them are idle."""
    sup, nat, reg = (D.table(s, d, t) for t in ("supplier", "nation", "region"))
    return (
        sup.join(nat, sup.s_nationkey == nat.n_nationkey)
        .join(reg, nat.n_regionkey == reg.r_regionkey)
        .select(
            F.col("s_suppkey").alias("worker_id"),
            (F.col("s_suppkey") % 3).alias("worker_type"),
            F.array("n_name", "r_name", F.when(F.col("s_acctbal") > 5000, "big").otherwise("small")).alias("offered"),
            F.when(F.col("s_suppkey") % 2 == 0, "idle").otherwise("busy").alias("state"),
            F.round(F.col("s_acctbal") * 100).cast("bigint").alias("heartbeat"),
        )
    )


def requirements(s, d):
    c, nat, reg = (D.table(s, d, t) for t in ("customer", "nation", "region"))
    joined = c.join(nat, c.c_nationkey == nat.n_nationkey).join(reg, nat.n_regionkey == reg.r_regionkey)
    seg = F.col("c_mktsegment")
    required = (
        F.when(seg == "BUILDING", F.array("n_name"))
        .when(seg == "MACHINERY", F.array(F.lit("big"), F.col("r_name")))
        .when(seg == "HOUSEHOLD", F.array(F.lit("gpu")))
        .otherwise(F.array().cast("array<string>"))
    )
    return joined.select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_custkey") % 4 < 3, F.col("c_custkey") % 4).alias("worker_type"),
        required.alias("required"),
        "c_nationkey",
    )


@query(
    "worker_match",
    "WITH w AS (SELECT s_suppkey AS worker_id, s_suppkey % 3 AS t, [n_name, r_name, CASE WHEN s_acctbal > 5000 THEN 'big' ELSE "
    "'small' END] AS labels, CAST(round(s_acctbal * 100) AS BIGINT) AS hb FROM supplier JOIN nation ON s_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 2 = 0), q AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 "
    "< 3 THEN c_custkey % 4 END AS t, CASE c_mktsegment WHEN 'BUILDING' THEN [n_name] WHEN 'MACHINERY' THEN ['big', r_name] WHEN "
    "'HOUSEHOLD' THEN ['gpu'] ELSE [] END AS labels FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON "
    "n_regionkey = r_regionkey) SELECT request_id, arg_min(worker_id, row(hb, worker_id)) AS worker_id FROM q LEFT JOIN w ON "
    "(q.t IS NULL OR q.t = w.t) AND list_has_all(w.labels, q.labels) GROUP BY request_id",
)
def _(s, d):
    return W.worker_match(requirements(s, d), fleet(s, d))


@query(
    "label_coverage",
    "SELECT c_custkey AS request_id, s_suppkey AS worker_id, CASE WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN cn.n_name <> "
    "sn.n_name THEN cn.n_name ELSE '' END WHEN c_mktsegment = 'MACHINERY' THEN concat_ws(',', CASE WHEN s_acctbal <= 5000 THEN 'big' "
    "END, CASE WHEN cn.n_regionkey <> sn.n_regionkey THEN r_name END) WHEN c_mktsegment = 'HOUSEHOLD' THEN 'gpu' ELSE '' END AS "
    "uncovered FROM customer JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey JOIN supplier "
    "ON s_suppkey = c_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey",
)
def _(s, d):
    f = fleet(s, d).select("worker_id", "offered")
    pairs = requirements(s, d).join(f, F.col("c_nationkey") == F.col("worker_id"))
    out = W.label_coverage(pairs)
    return out.select("request_id", "worker_id", F.array_join("uncovered", ",").alias("uncovered"))


@query(
    "service_counters",
    with_ctes(
        "ev conn",
        "SELECT 'executions_total' AS metric, '' AS label, count(*) AS value FROM x UNION ALL SELECT 'executions_active', '', count(*) "
        "FROM x WHERE exit_code IS NULL UNION ALL SELECT 'cache_hits', '', count(*) FROM ttl WHERE outcome = 'hit' UNION ALL SELECT "
        "'cache_misses', '', count(*) FROM ttl WHERE outcome <> 'hit' UNION ALL SELECT 'workers_connected', '', count(*) FROM latest "
        "UNION ALL SELECT 'workers_available', '', count(*) FROM latest WHERE state = 'idle' UNION ALL SELECT 'worker_executions', "
        "CAST(worker_id AS VARCHAR), count(*) FROM x GROUP BY worker_id UNION ALL SELECT 'worker_reconnections', CAST(worker AS VARCHAR), "
        "greatest(count(*) FILTER (WHERE event = 'connected') - 1, 0) FROM conn GROUP BY worker",
        x=EXECUTIONS,
        latest=LATEST,
        ttl="SELECT CASE WHEN us - put_us <= 3600000000 THEN 'hit' ELSE 'miss' END AS outcome FROM (SELECT *, max(CASE WHEN put THEN us "
        "END) OVER (PARTITION BY k ORDER BY us, NOT put, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS put_us FROM (SELECT *, "
        "event_type IN ('purchase', 'signup') AS put FROM ev)) WHERE NOT put",
    ),
)
def _(s, d):
    lookups = C.cache_lookup_ttl(D.cache_log(s, d), 3600)
    return W.service_counters(executions(s, d), lookups, D.worker_states(s, d), D.connection_events(s, d))


def connection_sql(reconnects: str) -> str:
    return with_ctes(
        "conn",
        f"SELECT c.*, {reconnects} AS reconnects, round(coalesce(mean_length_us, 0), 3) AS mean_length_us FROM (SELECT worker AS "
        "worker_id, count(*) FILTER (WHERE event = 'connected') AS connects, count(*) FILTER (WHERE event = 'disconnected') AS "
        "disconnects, count(*) FILTER (WHERE event = 'health_check_failed') AS failed_checks FROM conn GROUP BY worker) c LEFT JOIN "
        "(SELECT worker, avg(us - pus) AS mean_length_us FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY us DESC, seq "
        "DESC) AS rn FROM ends WHERE event = 'disconnected' AND pev = 'connected') WHERE rn <= 100 GROUP BY worker) m ON m.worker = "
        "c.worker_id",
        ends="SELECT *, lag(event) OVER w AS pev, lag(us) OVER w AS pus FROM conn WHERE event IN ('connected', 'disconnected') WINDOW w "
        "AS (PARTITION BY worker ORDER BY us, seq)",
    )


@query("connection_metrics", connection_sql("greatest(connects - 1, 0)"))
def _(s, d):
    out = W.connection_metrics(D.connection_events(s, d))
    return out.withColumn("mean_length_us", F.round("mean_length_us", 3))


@query(
    "connection_metrics_compat",
    connection_sql("(SELECT count(*) FROM ends WHERE ends.worker = c.worker_id AND event = 'connected' AND pev = 'connected')"),
)
def _(s, d):
    out = W.connection_metrics(D.connection_events(s, d), compat=True)
    return out.withColumn("mean_length_us", F.round("mean_length_us", 3))


TRIPS = (
    "SELECT *, row_number() OVER (PARTITION BY worker ORDER BY us DESC, seq DESC) AS rn FROM conn WHERE event = 'health_check_passed' "
    "AND seq > coalesce((SELECT max(seq) FROM conn c WHERE c.worker = conn.worker AND c.event = 'connected'), -1)"
)


@query(
    "rtt_stats",
    with_ctes("conn", "SELECT worker AS worker_id, count(*) AS round_trips, round(avg(rtt_us), 3) AS mean_us, min(rtt_us) AS min_us, "
              "max(rtt_us) AS max_us FROM trips WHERE rn <= 100 GROUP BY worker", trips=TRIPS),
)
def _(s, d):
    return W.rtt_stats(D.connection_events(s, d)).withColumn("mean_us", F.round("mean_us", 3))


@query(
    "latency_degradation",
    with_ctes(
        "conn",
        "SELECT f.worker AS worker_id, failing, failing OR coalesce(n >= 10 AND a > 2 * b, false) AS degraded FROM (SELECT worker, "
        "arg_max(event, seq) = 'health_check_failed' AS failing FROM conn WHERE event <> 'disconnected' GROUP BY worker) f LEFT JOIN "
        "(SELECT worker, count(*) AS n, avg(rtt_us) FILTER (WHERE rn <= 10) AS a, avg(rtt_us) FILTER (WHERE rn > 10) AS b FROM trips "
        "WHERE rn <= 20 GROUP BY worker) t ON t.worker = f.worker",
        trips=TRIPS,
    ),
)
def _(s, d):
    return W.latency_degradation(D.connection_events(s, d))


CHECKS = "SELECT * FROM conn WHERE event LIKE 'health_check%'"


@query(
    "failure_streaks",
    with_ctes(
        "conn",
        "SELECT worker AS worker_id, failed, count(*) AS length, min(us) AS first_ts, max(us) AS last_ts FROM (SELECT worker, us, "
        "event = 'health_check_failed' AS failed, row_number() OVER (PARTITION BY worker ORDER BY us, seq) - row_number() OVER "
        "(PARTITION BY worker, event ORDER BY us, seq) AS grp FROM checks) GROUP BY worker, failed, grp",
        checks=CHECKS,
    ),
)
def _(s, d):
    return us(W.failure_streaks(D.connection_events(s, d)), "first_ts", "last_ts").drop("began")


@query(
    "health_alerts",
    with_ctes(
        "conn",
        "SELECT worker AS worker_id, us AS ts, seq, CAST(failures AS BIGINT) AS failures FROM (SELECT *, sum(bad) OVER (PARTITION BY worker, island ORDER "
        "BY us, seq) AS failures FROM (SELECT *, sum(CASE WHEN bad = 0 AND pbad = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER "
        "BY us, seq) AS island FROM (SELECT *, lag(bad) OVER (PARTITION BY worker ORDER BY us, seq) AS pbad FROM (SELECT *, CASE WHEN "
        "event = 'health_check_failed' THEN 1 ELSE 0 END AS bad FROM checks)))) WHERE bad = 1 AND failures >= 3",
        checks=CHECKS,
    ),
)
def _(s, d):
    return us(W.health_alerts(D.connection_events(s, d)), "ts")


@query(
    "state_sojourn",
    with_ctes(
        "ev",
        "SELECT user_id AS worker_id, state, us AS ts, seq, prev_state, row_number() OVER w AS change, lead(us) OVER w - us AS "
        "sojourn_us FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY us, seq) AS prev_state FROM (SELECT *, CASE "
        "event_type WHEN 'view' THEN 'idle' WHEN 'error' THEN 'unhealthy' ELSE 'busy' END AS state FROM ev)) WHERE prev_state IS NULL "
        "OR prev_state <> state WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)",
    ),
)
def _(s, d):
    log = D.worker_states(s, d).withColumn("state", W.state_name(F.col("state_code")))
    return us(W.state_sojourn(log), "ts")


@query(
    "execution_progress",
    with_ctes("ev", "SELECT k AS execution_id, arg_max(value, seq) AS percent_complete, count(*) AS updates FROM ev GROUP BY k"),
)
def _(s, d):
    return W.execution_progress(D.worker_states(s, d))
