"""Registered queries for sources and sinks. Files are written by Spark from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlens.catalog import builds as CB
from buildlens.catalog.builds import SUMMARY_COLUMNS
from buildlens.catalog.sqltext import with_ctes
from buildlens.functions import exprs as X
from buildlens.operators import builds as B
from buildlens.plans import standins as D
from buildlens.session import scratch_path, written
from buildlens.sources import bench_results as R
from buildlens.sources import event_log as L
from buildlens.sources import history as H
from buildlens.sources import worker_messages as M

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def written_log(s, d):
    """Event lines below one directory per event type, with some blank and some broken lines."""
    e = D.event_log(s, d)
    body = F.to_json(
        F.struct(
            F.col("event_id").alias("sequence_number"),
            F.lit("Progress").alias("id"),
            F.struct(F.struct(F.col("k").cast("string").alias("stdout")).alias("Progress")).alias("payload"),
        )
    )
    line = F.when(F.col("k") % 10 == 0, F.concat(F.lit('{"broken": '), F.col("event_id").cast("string"))).when(
        F.col("k") % 10 == 1, "   "
    ).otherwise(F.concat(F.lit("  "), body))
    path = scratch_path(s, "event-log")
    e.select(F.col("event_type").alias("invocation_id"), line.alias("value")).write.partitionBy("invocation_id").text(path)
    return L.read_event_log(s, path)


@query(
    "read_event_log",
    with_ctes("ev", "SELECT event_type AS invocation_id, seq AS sequence_number, 'Progress' AS id, CAST(k AS VARCHAR) AS stdout "
              "FROM ev WHERE k % 10 > 1"),
)
def _(s, d):
    events, _bad = written_log(s, d)
    return events.select(
        "invocation_id", "sequence_number", "id", F.get_json_object("payload", "$.Progress.stdout").alias("stdout")
    )


@query(
    "read_event_log_rejects",
    with_ctes("ev", "SELECT event_type AS invocation_id, '{\"broken\": ' || seq AS line FROM ev WHERE k % 10 = 0"),
)
def _(s, d):
    return written_log(s, d)[1]


RAW = (
    "SELECT CAST(o_orderkey AS VARCHAR) AS invocation_id, 0 AS sequence_number, 'BuildStarted' AS id, 'BuildStarted' AS kind, NULL AS "
    "label, epoch_us(o_orderdate) AS event_us, false AS last_message FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), "
    "1000000000, 'BuildFinished', 'BuildFinished', NULL, epoch_us(o_orderdate), true FROM orders UNION ALL SELECT CAST(inv AS VARCHAR), "
    "seq, 'ActionCompleted:' || label, 'ActionExecuted', label, epoch_us(l_shipdate), false FROM act UNION ALL SELECT CAST(inv AS "
    "VARCHAR), seq, 'TestResult:' || label, 'TestResult', label, epoch_us(l_shipdate), false FROM act"
)


@query("normalize_event", with_ctes("act", RAW))
def _(s, d):
    flat = L.normalize_event(L.decode_filter(D.raw_events(s, d)))
    return flat.select(
        "invocation_id", "sequence_number", "id", "kind", "label", F.unix_micros("event_ts").alias("event_us"), "last_message"
    )


ERRORS = (
    "SELECT CAST(o_orderkey AS VARCHAR) AS invocation_id, 1000000000 AS sequence_number, 'stopped: ' || o_orderpriority AS error "
    "FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT CAST(inv AS VARCHAR), seq, 'broken: ' || label FROM act WHERE NOT ok"
)


def reported(s, d):
    return L.normalize_event(L.decode_filter(D.raw_events(s, d, completions=True)))


@query("build_errors", with_ctes("act", ERRORS))
def _(s, d):
    return B.build_errors(reported(s, d))


@query(
    "build_summary_errors",
    with_ctes(
        "act",
        "SELECT CAST(o_orderkey AS VARCHAR) AS invocation_id, CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'failure' END AS "
        "status, coalesce((SELECT string_agg(error, ';' ORDER BY sequence_number, error) FROM err WHERE err.invocation_id = "
        "CAST(o_orderkey AS VARCHAR)), '') AS errors FROM orders",
        err=ERRORS,
    ),
)
def _(s, d):
    flat = L.parsed_once(L.decode_filter(D.raw_events(s, d, completions=True)), L.SUMMARY_FIELDS)
    out = B.build_summary(flat, targets=False, errors=True)
    return out.select("invocation_id", "status", F.array_join("errors", ";").alias("errors"))


@query(
    "decode_filter",
    with_ctes("act", f"SELECT invocation_id, count(*) AS events FROM ({RAW}) GROUP BY invocation_id"),
)
def _(s, d):
    return L.decode_filter(D.raw_events(s, d)).groupBy("invocation_id").agg(F.count(F.lit(1)).alias("events"))


@query(
    "event_edges",
    with_ctes(
        "act",
        "SELECT CAST(inv AS VARCHAR) AS invocation_id, 'ActionCompleted:' || label AS parent_id, 'TestResult:' || label AS child_id, "
        "label AS child_label FROM act UNION ALL SELECT CAST(inv AS VARCHAR), 'TestResult:' || label, NULL, NULL FROM act UNION ALL "
        "SELECT CAST(o_orderkey AS VARCHAR), 'BuildStarted', unnest(['Pattern://a,//b', 'BuildFinished']), NULL FROM orders UNION ALL "
        "SELECT CAST(o_orderkey AS VARCHAR), 'BuildFinished', NULL, NULL FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), "
        "'Progress', NULL, NULL FROM orders",
    ),
)
def _(s, d):
    return L.event_edges(D.raw_events(s, d))


@query(
    "summary_from_log",
    with_ctes(
        "act",
        "SELECT CAST(o_orderkey AS VARCHAR) AS invocation_id, CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'failure' END AS status, "
        "o_orderpriority AS command, coalesce(n, 0) AS total_actions, coalesce(c, 0) AS cached_actions FROM orders LEFT JOIN (SELECT inv, "
        "count(*) AS n, count(*) FILTER (WHERE ok AND took = 0) AS c FROM act GROUP BY inv) ON inv = o_orderkey",
    ),
)
def _(s, d):
    flat = L.parsed_once(L.decode_filter(D.raw_events(s, d)), L.SUMMARY_FIELDS)
    out = B.build_summary(flat, targets=False)
    return out.select("invocation_id", "status", "command", "total_actions", "cached_actions")


def _target_history(s, d):
    done = written(CB.executions(s, d), "executions")  # both appends read it
    path = scratch_path(s, "target-history")
    H.append_target_history(done.filter("status = 'success'"), path)
    H.append_target_history(done.filter("status <> 'success'"), path)
    return H.read_target_history(s, path)


TARGET_HISTORY = with_ctes(
    "execs env",
    f"SELECT CAST(inv AS VARCHAR) AS invocation_id, {CB.EXEC_COLUMNS.split(',', 1)[1]}, {CB.ENV_TEXT} FROM execs",
)


@query("append_target_history", TARGET_HISTORY)
def _(s, d):
    return CB.shown(_target_history(s, d))


@query("read_target_history", f"SELECT label, count(*) AS records FROM ({TARGET_HISTORY}) GROUP BY label")
def _(s, d):
    return _target_history(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("records"))


def _test_history(s, d):
    path = scratch_path(s, "test-history")
    H.append_test_history(CB.runs(s, d), path)
    return H.read_test_history(s, path)


@query(
    "append_test_history",
    with_ctes("tst", "SELECT label, CAST(inv AS VARCHAR) AS invocation_id, status, cl AS cached_locally, cr AS cached_remotely, "
              "duration_ms FROM tst"),
)
def _(s, d):
    return _test_history(s, d).drop("start_time", "end_time", "ingest_order")


@query("read_test_history", with_ctes("tst", "SELECT label, count(*) AS records FROM tst GROUP BY label"))
def _(s, d):
    return _test_history(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("records"))


def _stored_summary(s, d):
    """Summaries stored twice: a first version that knows no status yet, then the real one for closed builds."""
    path = scratch_path(s, "summary")
    real = written(CB.summary(s, d, targets=False), "summaries")  # both versions are made from it
    H.write_summary(real.withColumn("status", F.lit("in_progress")), path, version=1)
    H.write_summary(real.filter("status <> 'in_progress'"), path, version=2)
    return H.read_summary(s, path)


@query("compact_summaries", with_ctes("summary", f"SELECT {SUMMARY_COLUMNS} FROM summary"))
def _(s, d):
    path = scratch_path(s, "compacted")
    real = written(CB.summary(s, d, targets=False), "summaries")  # both versions are made from it
    H.write_summary(real.withColumn("status", F.lit("in_progress")), path, version=1)
    H.compact_summaries(s, path)
    H.write_summary(real.filter("status <> 'in_progress'"), path, version=2)
    H.compact_summaries(s, path)
    return H.read_summary(s, path)


@query("write_summary", with_ctes("summary", f"SELECT {SUMMARY_COLUMNS} FROM summary"))
def _(s, d):
    return _stored_summary(s, d)


@query(
    "read_summary",
    with_ctes("summary", "SELECT c_custkey AS invocation_id, coalesce(status, 'in_progress') AS status, coalesce(total_actions, 0) AS "
              "total_actions FROM customer LEFT JOIN summary ON inv = c_custkey"),
)
def _(s, d):
    out = B.read_side_defaults(_stored_summary(s, d), CB.customer_ids(s, d))
    return out.select("invocation_id", "status", "total_actions")


@query(
    "read_worker_messages",
    with_ctes(
        "ev",
        "SELECT seq, user_id AS worker_id, CASE event_type WHEN 'signup' THEN 'registration' WHEN 'purchase' THEN 'result' WHEN 'error' "
        "THEN 'progress' ELSE 'heartbeat' END AS kind, CASE WHEN event_type IN ('view', 'click') THEN CASE k % 4 WHEN 0 THEN 'idle' WHEN "
        "1 THEN 'busy' ELSE 'unhealthy' END END AS state, CASE WHEN event_type IN ('purchase', 'error') THEN 'exec-' || k END AS "
        "execution_id, CASE WHEN event_type = 'purchase' THEN CAST(k % 2 AS INTEGER) END AS exit_code, CASE WHEN event_type = 'signup' "
        "THEN 'type-' || (k % 3) END AS worker_type FROM ev",
    ),
)
def _(s, d):
    e = D.event_log(s, d)
    kind = X.lookup(F.col("event_type"), {"signup": "registration", "purchase": "result", "error": "progress"}, "heartbeat")
    k = F.col("k")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("type-"), (k % 3).cast("string")).alias("worker_type"),
            (k % 4).cast("int").alias("state"),
            F.concat(F.lit("exec-"), k.cast("string")).alias("execution_id"),
            (k % 2).cast("int").alias("exit_code"),
        )
    )
    kinds = M.read_worker_messages(e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("worker_id"), kind.alias("kind"), body.alias("body")))
    wanted = {"state": "string", "execution_id": "string", "exit_code": "int", "worker_type": "string"}
    out = None
    for name, df in kinds.items():
        part = df.select(
            "seq",
            "worker_id",
            F.lit(name).alias("kind"),
            *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()],
        )
        out = part if out is None else out.unionByName(part)
    return out


def _bench_files(s, d):
    """One result document per supplier with a nested part, and the same numbers as CSV."""
    li = D.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(
        F.max("l_quantity").alias("q"), F.min("l_linenumber").alias("ln"), F.count(F.lit(1)).alias("n")
    )
    return li.select(
        "run",
        F.struct(F.col("q").alias("p99"), F.struct(F.when(F.col("run") % 2 == 0, F.col("n")).alias("actions")).alias("load")).alias("results"),
        F.lit("full").alias("mode"),
    )


BENCH = (
    "SELECT run, metric, text, TRY_CAST(text AS DOUBLE) AS value FROM (SELECT l_suppkey AS run, CAST(max(l_quantity) AS VARCHAR) AS p99, "
    "CASE WHEN l_suppkey % 2 = 0 THEN CAST(count(*) AS VARCHAR) ELSE 'N/A' END AS actions FROM lineitem GROUP BY 1), LATERAL (VALUES "
    "('results.p99', p99), ('results.load.actions', actions), ('mode', 'full')) t(metric, text)"
)


@query("read_bench_results", BENCH)
def _(s, d):
    rows = _bench_files(s, d)
    path = scratch_path(s, "bench")
    rows.write.json(f"{path}/json")
    flat = rows.select("run", F.col("results.p99").alias("results.p99"), F.col("mode"))
    flat.write.option("header", "true").csv(f"{path}/csv")
    from_json = R.read_bench_json(s, f"{path}/json", "run", schema=rows.schema, multi_line=False)
    from_csv = R.read_bench_csv(s, f"{path}/csv", "run").withColumn("run", F.col("run").cast("bigint"))
    # both files carry the same numbers where they overlap
    only_json = from_json.join(from_csv.select("run", "metric"), ["run", "metric"], "left_anti")
    return from_csv.unionByName(only_json)


@query(
    "latest_run_per_family",
    with_ctes("ev", "SELECT event_type || '_' || (user_id % 7) AS family, arg_max('results/' || event_type || '_' || (user_id % 7) || "
              "'x_2024' || k || '_' || seq || '.json', seq) AS path, max(us) AS modified FROM ev GROUP BY 1").replace(
        "AS family", "|| 'x' AS family", 1),
)
def _(s, d):
    e = D.event_log(s, d)
    name = F.concat(
        F.lit("results/"), "event_type", F.lit("_"), (F.col("user_id") % 7).cast("string"), F.lit("x_2024"), F.col("k").cast("string"),
        F.lit("_"), F.col("event_id").cast("string"), F.lit(".json"),
    )
    files = e.select(name.alias("path"), F.unix_micros("ts").alias("modified"))
    return R.latest_run_per_family(files)


@query(
    "write_report",
    "SELECT l_suppkey AS run, max(l_quantity) AS p99, count(*) AS actions FROM lineitem GROUP BY 1",
)
def _(s, d):
    report = _bench_files(s, d).select("run", "results.p99")
    n = D.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.count(F.lit(1)).alias("actions"))
    path = scratch_path(s, "report")
    report = report.join(n, "run")
    R.write_report(report, path)
    from_json = s.read.schema(report.schema).json(f"{path}/json")
    from_csv = s.read.schema(report.schema).option("header", "true").csv(f"{path}/csv")
    return from_json.join(from_csv.select("run", F.col("actions").alias("a")), "run").filter("actions = a").drop("a")


@query(
    "retention",
    with_ctes("ev", "SELECT seq, us FROM ev WHERE us >= (SELECT max(us) FROM ev) - 7 * 86400000000"),
)
def _(s, d):
    e = D.event_log(s, d)
    now = e.agg(F.unix_micros(F.max("ts"))).first()[0]
    return H.retention(e, now, 7).select(F.col("event_id").alias("seq"), F.unix_micros("ts").alias("us"))


