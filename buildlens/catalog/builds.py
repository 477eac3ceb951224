"""Registered queries for build events, targets and tests, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlens.catalog.sqltext import RFC, with_ctes
from buildlens.functions import exprs as X
from buildlens.operators import builds as B
from buildlens.operators import targets as T
from buildlens.plans import standins as D

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SUMMARY_COLUMNS = (
    "inv AS invocation_id, command, workspace, start_time, end_time, duration_ms, false AS clock_skew, status, "
    "total_actions, cached_actions, local_actions, failed_actions, remote_cache_hits, cached_test_results, "
    "CAST(0 AS BIGINT) AS cached_test_runs"
)


def summary(s, d, **options):
    return B.build_summary(D.build_events(s, d), **options)


def metrics(s, d):
    return B.action_metrics(D.actions(s, d))


def executions(s, d, build=True, env=True):
    """Target executions, with the build's times and environment where they are asked for."""
    done = D.completions(s, d)
    times = summary(s, d, targets=False) if build else None
    maps = B.env_maps(B.build_env(D.command_lines(s, d))) if env else None
    rows = T.target_executions(done, D.target_kinds(s, d), metrics(s, d), times, maps)
    return rows.withColumn("ingest_order", F.struct("event_ts", "invocation_id"))


def runs(s, d):
    return T.test_executions(D.tests(s, d))


def customer_ids(s, d):
    """Requested build ids: customer numbers, of which many are no build at the larger scales and some are."""
    return D.table(s, d, "customer").select(F.col("c_custkey").alias("invocation_id"))


def supplier_labels(s, d):
    return D.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("label"))


@query(
    "build_summary",
    with_ctes(
        "summary seen",
        f"SELECT {SUMMARY_COLUMNS}, coalesce((SELECT string_agg(label, ',' ORDER BY first_seq, label) FROM seen "
        "WHERE seen.inv = summary.inv), '') AS targets FROM summary",
    ),
)
def _(s, d):
    return summary(s, d).withColumn("targets", F.array_join("targets", ","))


@query(
    "build_summary_compat",
    with_ctes("summary", "SELECT inv AS invocation_id, cached_actions + cached_test_results AS cached_actions FROM summary"),
)
def _(s, d):
    return summary(s, d, compat=True, targets=False).select("invocation_id", "cached_actions")


@query(
    "action_metrics",
    with_ctes("metrics", "SELECT inv AS invocation_id, label, action_count, action_duration_ms, cached_actions, "
              "failed_actions FROM metrics"),
)
def _(s, d):
    return metrics(s, d)


MISSES = (
    "SELECT inv AS invocation_id, label, 'Type' || l_linenumber AS type, ok AS success, false AS cached, "
    "CASE WHEN ok THEN 0 ELSE 1 END AS exit_code, took AS duration_ms, 'ActionCompleted:' || label AS event_id "
    "FROM act WHERE NOT (ok AND took = 0)"
)


@query("cache_misses", with_ctes("act", MISSES))
def _(s, d):
    return B.cache_misses(D.actions(s, d))


@query(
    "miss_search",
    with_ctes("act", "SELECT * FROM misses WHERE contains(lower(label), 'type3') OR contains(lower(type), 'type3')",
              misses=MISSES),
)
def _(s, d):
    return B.miss_search(B.cache_misses(D.actions(s, d)), "type3")


@query(
    "cache_rule_audit",
    with_ctes("act", "SELECT ok AND took = 0 AS summary_rule, hit AS metrics_rule, ok AND took = 0 AS miss_rule, "
              "count(*) AS actions FROM act GROUP BY ALL"),
)
def _(s, d):
    return B.cache_rule_audit(D.actions(s, d))


@query(
    "global_stats",
    with_ctes(
        "summary",
        "SELECT count(*) AS total_builds, count(*) FILTER (WHERE status = 'in_progress') AS in_progress_builds, "
        "count(*) FILTER (WHERE status = 'success') AS successful_builds, "
        "count(*) FILTER (WHERE status = 'failure') AS failed_builds, "
        "CAST(sum(total_actions) AS BIGINT) AS total_actions, CAST(sum(failed_actions) AS BIGINT) AS failed_actions "
        "FROM summary",
    ),
)
def _(s, d):
    return B.global_stats(summary(s, d, targets=False))


@query(
    "cache_hit_ratio",
    with_ctes("summary", "SELECT inv AS invocation_id, CASE WHEN total_actions = 0 THEN 0 ELSE "
              "CAST(floor(100.0::DOUBLE * cached_actions / total_actions + 0.5) AS BIGINT) END AS hit_percent FROM summary"),
)
def _(s, d):
    return B.cache_hit_ratio(summary(s, d, targets=False))


RECENT = (
    f"SELECT o_orderkey AS invocation_id, {RFC.format('o_orderdate')} AS start_time, "
    "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failure' ELSE 'in_progress' END AS status FROM orders "
    "ORDER BY start_time DESC NULLS LAST, invocation_id DESC"
)


@query("builds_recent", RECENT)
def _(s, d):
    return B.builds_recent(D.build_rows(s, d).select("invocation_id", "start_time", "status"))


@query("dashboard_recent", RECENT + " LIMIT 10")
def _(s, d):
    return B.dashboard_recent(D.build_rows(s, d).select("invocation_id", "start_time", "status"))


@query(
    "build_lookup",
    f"SELECT o_orderkey AS invocation_id, {RFC.format('o_orderdate')} AS start_time, o_orderpriority AS command "
    "FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer)",
)
def _(s, d):
    builds = D.build_rows(s, d).select("invocation_id", "start_time", "command")
    return B.build_lookup(builds, customer_ids(s, d))


@query(
    "build_events",
    with_ctes(
        "act",
        "SELECT invocation_id, sequence_number, kind, label FROM ("
        "SELECT o_orderkey AS invocation_id, 0 AS sequence_number, 'BuildStarted' AS kind, NULL AS label FROM orders "
        "UNION ALL SELECT o_orderkey, (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 30) * 16, "
        "'BuildMetrics', NULL FROM orders "
        "UNION ALL SELECT o_orderkey, 1000000000, 'BuildFinished', NULL FROM orders WHERE o_orderstatus <> 'O' "
        "UNION ALL SELECT inv, seq, 'ActionExecuted', label FROM act "
        "UNION ALL SELECT inv, seq, 'TestResult', label FROM act WHERE l_linestatus = 'F') "
        "WHERE invocation_id IN (SELECT c_custkey FROM customer) ORDER BY invocation_id, sequence_number",
    ),
)
def _(s, d):
    events = D.build_events(s, d).select("invocation_id", "sequence_number", "kind", "label")
    return B.build_events(events, customer_ids(s, d))


EXEC_COLUMNS = (
    "inv AS invocation_id, label, target_kind, status, array_to_string(tags, ',') AS tags, "
    "start_time AS build_start_time, end_time AS build_end_time, duration_ms AS build_duration_ms, "
    "action_duration_ms, action_count, cached_actions, failed_actions"
)
ENV_TEXT = (
    "(SELECT string_agg(key || '=' || value, ';' ORDER BY key) FROM env WHERE env.inv = execs.inv) AS env_vars"
)


def shown(df):
    """Arrays and maps as text, so that any engine can compare the rows."""
    columns = [c for c in df.columns if c not in ("success", "event_ts", "ingest_order")]
    out = df.select(*columns)
    if "tags" in columns:
        out = out.withColumn("tags", F.array_join("tags", ","))
    if "env_vars" in columns:
        entries = F.array_sort(F.transform(F.map_entries("env_vars"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
        out = out.withColumn("env_vars", F.array_join(entries, ";"))
    return out


@query("target_executions", with_ctes("execs env", f"SELECT {EXEC_COLUMNS}, {ENV_TEXT} FROM execs"))
def _(s, d):
    return shown(executions(s, d))


@query(
    "build_targets",
    with_ctes("execs", f"SELECT {EXEC_COLUMNS} FROM execs WHERE inv IN (SELECT c_custkey FROM customer) "
              "ORDER BY inv, label"),
)
def _(s, d):
    return shown(T.build_targets(executions(s, d, env=False), customer_ids(s, d)))


@query(
    "target_history",
    with_ctes("execs", f"SELECT {EXEC_COLUMNS} FROM execs WHERE label IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"
              " ORDER BY label, pos"),
)
def _(s, d):
    return shown(T.history(executions(s, d, env=False), supplier_labels(s, d)))


ROLLUP = with_ctes(
    "execs",
    "SELECT base.*, coalesce((SELECT string_agg(tag, ',' ORDER BY p, i) FROM tags WHERE tags.label = base.label), '') "
    "AS tags FROM base",
    base="SELECT label, coalesce(arg_min(target_kind, pos) FILTER (WHERE target_kind <> ''), '') AS target_kind, "
    "arg_max(status, pos) AS latest_status, count(*) AS total_executions, "
    "count(*) FILTER (WHERE status = 'success') AS success_count, "
    "count(*) FILTER (WHERE status = 'failure') AS failure_count, CAST(0 AS BIGINT) AS cached_count, "
    "CAST(sum(action_count) AS BIGINT) AS action_count, CAST(sum(cached_actions) AS BIGINT) AS cached_actions, "
    "CAST(sum(failed_actions) AS BIGINT) AS failed_actions FROM execs GROUP BY label",
    tags="SELECT label, tag, min(pos) AS p, min(i) AS i FROM (SELECT label, pos, unnest(tags) AS tag, "
    "generate_subscripts(tags, 1) AS i FROM execs) GROUP BY label, tag",
)


def rollup(s, d):
    return T.target_rollup(executions(s, d, build=False, env=False))


@query("target_rollup", ROLLUP)
def _(s, d):
    return shown(rollup(s, d))


@query("targets_ranked", f"SELECT * FROM ({ROLLUP}) ORDER BY total_executions DESC, label")
def _(s, d):
    return shown(T.ranked(rollup(s, d), "total_executions"))


@query(
    "target_search",
    f"SELECT * FROM ({ROLLUP}) WHERE (contains(lower(label), 'econ') OR contains(lower(target_kind), 'econ')) "
    "AND latest_status = 'failure'",
)
def _(s, d):
    return shown(T.target_search(rollup(s, d), "Econ", "failure"))


@query(
    "distinct_ordered",
    f"SELECT label, tags FROM ({ROLLUP}) WHERE tags <> ''",
)
def _(s, d):
    return shown(T.distinct_ordered(executions(s, d, build=False, env=False), "label", "tags", "ingest_order"))


@query("latest_status", with_ctes("execs", "SELECT label, arg_max(status, pos) AS latest_status FROM execs GROUP BY label"))
def _(s, d):
    return T.latest_status(executions(s, d, build=False, env=False))


@query(
    "latest_env",
    with_ctes("execs env", "SELECT label, key, value FROM (SELECT label, arg_max(inv, pos) AS inv FROM execs GROUP BY label) l "
              "JOIN env USING (inv)"),
)
def _(s, d):
    return T.latest_env(executions(s, d, build=False))


@query(
    "duration_timeline",
    with_ctes(
        "execs",
        "SELECT inv AS invocation_id, label, bar_ms, longest_ms, "
        "greatest(100.0::DOUBLE * bar_ms / longest_ms, 2.0::DOUBLE) AS width_percent FROM (SELECT *, "
        "greatest(max(bar_ms) OVER (PARTITION BY label), 1) AS longest_ms FROM (SELECT *, CASE WHEN action_duration_ms > 0 "
        "THEN action_duration_ms ELSE coalesce(duration_ms, 0) END AS bar_ms FROM execs))",
    ),
)
def _(s, d):
    out = T.duration_timeline(executions(s, d, env=False))
    return out.select("invocation_id", "label", "bar_ms", "longest_ms", "width_percent")


@query(
    "test_executions",
    with_ctes("tst", "SELECT label, inv AS invocation_id, status, cl AS cached_locally, cr AS cached_remotely, "
              "epoch_us(l_shipdate) AS start_us, duration_ms FROM tst"),
)
def _(s, d):
    return runs(s, d).withColumn("start_us", F.unix_micros("start_ts")).drop("ingest_order", "sequence_number", "start_ts")


TEST_ROLLUP = with_ctes(
    "tst",
    "SELECT label, arg_max(status, pos) AS latest_status, count(*) AS total_runs, "
    "count(*) FILTER (WHERE status = 'PASSED') AS passed_count, "
    "count(*) FILTER (WHERE status NOT IN ('PASSED', 'FLAKY', 'NO_STATUS')) AS failed_count, "
    "count(*) FILTER (WHERE cl OR cr) AS cached_count, count(*) FILTER (WHERE status = 'FLAKY') AS flaky_count "
    "FROM tst GROUP BY label",
)


@query("test_rollup", TEST_ROLLUP)
def _(s, d):
    return T.test_rollup(runs(s, d))


@query("tests_ranked", f"SELECT * FROM ({TEST_ROLLUP}) ORDER BY total_runs DESC, label")
def _(s, d):
    return T.ranked(T.test_rollup(runs(s, d)), "total_runs")


@query("test_search", f"SELECT * FROM ({TEST_ROLLUP}) WHERE contains(lower(label), '12')")
def _(s, d):
    return T.test_search(T.test_rollup(runs(s, d)), "12")


@query(
    "test_history",
    with_ctes("tst", "SELECT label, inv AS invocation_id, status, cl AS cached_locally, cr AS cached_remotely, "
              "epoch_us(l_shipdate) AS start_us, duration_ms FROM tst "
              "WHERE label IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) ORDER BY label, pos"),
)
def _(s, d):
    out = T.history(runs(s, d), supplier_labels(s, d))
    return out.withColumn("start_us", F.unix_micros("start_ts")).drop("ingest_order", "sequence_number", "start_ts")


@query(
    "test_status_mix",
    with_ctes("tst", "SELECT CASE WHEN status = 'PASSED' THEN 'pass' WHEN status = 'FLAKY' THEN 'flaky' "
              "WHEN status = 'NO_STATUS' THEN 'other' ELSE 'fail' END AS status_group, count(*) AS runs FROM tst GROUP BY 1"),
)
def _(s, d):
    return T.test_status_mix(runs(s, d))


@query("build_env", with_ctes("env", "SELECT inv AS invocation_id, key, value FROM env"))
def _(s, d):
    return B.build_env(D.command_lines(s, d))


@query(
    "union_sources",
    f"SELECT o_orderkey AS invocation_id, CASE WHEN o_orderstatus = 'O' THEN 'live' ELSE 'stored' END AS origin, "
    f"{RFC.format('o_orderdate')} AS start_time FROM orders",
)
def _(s, d):
    rows = D.build_rows(s, d).select("invocation_id", "start_time", "status")
    live = rows.filter(F.col("status") == "in_progress").withColumn("origin", F.lit("live")).drop("status")
    return B.union_sources(live, rows.withColumn("origin", F.lit("stored")).drop("status"))


@query(
    "client_versions",
    "SELECT major, minor, 0 AS patch, count(*) AS builds, count(*) FILTER (WHERE p_size > 25) AS successful, "
    "count(*) FILTER (WHERE p_size <= 25) AS failed FROM (SELECT p_size, "
    "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS major, p_size AS minor FROM part "
    "WHERE p_type <> 'PROMO' UNION ALL SELECT p_size, NULL, NULL FROM part WHERE p_type = 'PROMO') GROUP BY ALL",
)
def _(s, d):
    p = D.table(s, d, "part")
    text = F.concat(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("."), F.col("p_size").cast("string"))
    builds = p.select(
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit(" "), text, F.lit(".x "))).alias("header"),
        F.when(F.col("p_type") == "PROMO", F.lit("curl/8")).otherwise(F.concat(F.lit("tool Bazel/"), text, F.lit(".0 (x)")))
        .alias("user_agent"),
        F.when(F.col("p_size") > 25, "success").otherwise("failure").alias("status"),
    )
    out = B.client_versions(builds)
    # versions that cannot be read form one group of their own
    unread = F.col("major").isNull()
    return out.withColumn("patch", F.when(unread, F.lit(0)).otherwise(F.col("patch")))
