"""Registered queries for benchmark analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlens.catalog.sqltext import with_ctes
from buildlens.operators import benchmarks as M
from buildlens.plans import ranks as R
from buildlens.plans import standins as D

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df, *columns, digits: int = 6):
    """Sums of doubles depend on their order; six digits do not."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def samples(s, d):
    """Latency samples: one run per event type."""
    e = D.event_log(s, d)
    return e.select(
        F.col("event_type").alias("op"),
        F.col("user_id").alias("run"),
        F.col("value").alias("duration"),
        F.when(F.col("event_type") == "error", F.col("k") % 2 == 0).otherwise(F.col("k") % 10 != 0).alias("success"),
        F.col("event_type").isin("purchase", "signup").alias("hit"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
        F.col("k").alias("bytes"),
        "ts",
        F.col("event_id").alias("seq"),
    )


SAMPLES = (
    "SELECT event_type AS op, user_id AS run, value AS duration, CASE WHEN event_type = 'error' THEN k % 2 = 0 "
    "ELSE k % 10 <> 0 END AS success, event_type IN ('purchase', 'signup') AS hit, "
    "event_type = 'error' AS failed, k AS bytes, ts, seq FROM ev"
)
RANK = "list_sort(list({v}) FILTER (WHERE {ok}))[CAST(least(floor(count(*) FILTER (WHERE {ok}) * {p} / 100), " \
       "count(*) FILTER (WHERE {ok}) - 1) AS BIGINT) + 1]"


def rank(p, v="duration", ok="success"):
    return RANK.format(v=v, ok=ok, p=p)


LATENCY = (
    "count(*) FILTER (WHERE success) AS n, min(duration) FILTER (WHERE success) AS min, "
    "max(duration) FILTER (WHERE success) AS max, round(avg(duration) FILTER (WHERE success), 6) AS mean, "
    "round(median(duration) FILTER (WHERE success), 6) AS median, "
    f"{rank(95)} AS p95, {rank(99)} AS p99, round(stddev_samp(duration) FILTER (WHERE success), 6) AS stddev"
)


# groups without a success are zero, not null
LATENCY_BY_RUN = with_ctes(
    "ev",
    "SELECT run, op, n, coalesce(min, 0) AS min, coalesce(max, 0) AS max, coalesce(mean, 0) AS mean, "
    "coalesce(median, 0) AS median, coalesce(p95, 0) AS p95, coalesce(p99, 0) AS p99, coalesce(stddev, 0) AS stddev "
    f"FROM (SELECT run, op, {LATENCY} FROM smp GROUP BY run, op)",
    smp=SAMPLES,
)


@query("latency_summary", LATENCY_BY_RUN)
def _(s, d):
    return rounded(M.latency_summary(samples(s, d), ["run", "op"]), "mean", "median", "stddev")


@query("latency_by_operation", with_ctes("ev", f"SELECT op, {LATENCY} FROM smp GROUP BY op", smp=SAMPLES))
def _(s, d):
    return rounded(M.latency_summary(samples(s, d), ["op"]), "mean", "median", "stddev")


@query(
    "nearest_rank",
    with_ctes(
        "ev",
        "SELECT op, percentile, value FROM (SELECT op, "
        + ", ".join(f"{rank(p, ok='true')} AS p{p}" for p in (50, 95, 99, 100))
        + " FROM smp GROUP BY op) UNPIVOT (value FOR percentile IN (p50, p95, p99, p100))",
        smp=SAMPLES,
    ).replace("SELECT op, percentile, value", "SELECT op, CAST(substr(percentile, 2) AS INTEGER) AS percentile, value"),
)
def _(s, d):
    return R.nearest_rank(samples(s, d), ["op"], "duration", [50, 95, 99, 100])


@query(
    "serial_throughput",
    with_ctes("ev", "SELECT op, round(count(*) * 1000.0::DOUBLE / sum(duration), 6) AS per_second FROM smp WHERE success "
              "GROUP BY op", smp=SAMPLES),
)
def _(s, d):
    return rounded(M.serial_throughput(samples(s, d), ["op"]), "per_second")


RATES = with_ctes(
    "ev",
    "SELECT run, count(*) AS total, count(*) FILTER (WHERE success) AS successes, "
    "count(*) FILTER (WHERE success AND hit) AS hits, "
    "CASE WHEN count(*) FILTER (WHERE success) > 0 THEN count(*) FILTER (WHERE success AND hit)::DOUBLE / "
    "count(*) FILTER (WHERE success) ELSE 0 END AS hit_rate, "
    "count(*) FILTER (WHERE success)::DOUBLE / count(*) AS success_rate, "
    "CAST(coalesce(sum(bytes) FILTER (WHERE success), 0) AS BIGINT) AS bytes_moved FROM smp GROUP BY run",
    smp=SAMPLES,
)


@query("hit_rate", f"SELECT run, successes, hits, hit_rate FROM ({RATES})")
def _(s, d):
    return M.rates(samples(s, d), ["run"]).select("run", "successes", "hits", "hit_rate")


@query("success_rate", f"SELECT run, total, successes, success_rate, bytes_moved FROM ({RATES})")
def _(s, d):
    return M.rates(samples(s, d), ["run"]).select("run", "total", "successes", "success_rate", "bytes_moved")


@query(
    "stampede_verdict",
    with_ctes(
        "ev",
        "SELECT * EXCLUDE (mean), round(mean, 6) AS mean, CASE WHEN p99 IS NULL THEN 'no data' "
        "WHEN p99 / mean < 2 AND errors = 0 THEN 'excellent' WHEN p99 / mean < 3 AND errors < total * 0.01 THEN 'good' "
        "WHEN errors > total * 0.05 THEN 'critical' ELSE 'warning' END AS verdict FROM (SELECT run, count(*) AS total, "
        "count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit AND NOT failed) AS misses, "
        "count(*) FILTER (WHERE failed) AS errors, avg(duration) FILTER (WHERE NOT failed) AS mean, "
        f"{rank(99, ok='NOT failed')} AS p99 FROM smp GROUP BY run)",
        smp=SAMPLES,
    ),
)
def _(s, d):
    return rounded(M.stampede_verdict(samples(s, d), ["run"]), "mean").drop("ratio")


@query(
    "blocking_score",
    with_ctes(
        "act",
        "SELECT *, CASE WHEN action_class = 'fast' THEN CASE WHEN total_ms_avg < 500 THEN 'excellent' "
        "WHEN total_ms_avg < 2000 THEN 'warning' ELSE 'critical' END END AS latency_band, "
        "CASE WHEN action_class = 'fast' THEN CASE WHEN total_ms_avg < 200 THEN 'none' "
        "WHEN total_ms_avg < 1000 THEN 'minimal' ELSE 'significant' END END AS blocking_band FROM (SELECT run, action_class, "
        "count(*) AS actions, "
        + ", ".join(
            f"{f}(nullif({c}, 0)) AS {c}_{f}" for c in ("queue_ms", "total_ms") for f in ("min", "avg", "max")
        )
        + " FROM (SELECT worker AS run, CASE WHEN l_quantity < 25 THEN 'fast' ELSE 'slow' END AS action_class, "
        "CAST(round(l_discount * 1000) AS BIGINT) AS queue_ms, CAST(round(l_discount * 1000) AS BIGINT) + took * 20 "
        "AS total_ms FROM act) GROUP BY run, action_class)",
    ),
)
def _(s, d):
    li = D.table(s, d, "lineitem")
    queue = F.round(F.col("l_discount") * 1000).cast("bigint")
    took = F.when(F.col("l_discount") == 0, F.lit(0)).otherwise(F.col("l_quantity")).cast("bigint")
    timings = li.select(
        F.col("l_suppkey").alias("run"),
        F.when(F.col("l_quantity") < 25, "fast").otherwise("slow").alias("action_class"),
        queue.alias("queue_ms"),
        (queue + took * 20).alias("total_ms"),
    )
    return M.blocking_score(timings, ["run"])


@query(
    "churn_verdict",
    with_ctes(
        "ev",
        "SELECT *, CASE WHEN failed = 0 THEN 'excellent' WHEN failed::DOUBLE / total < 0.05 THEN 'good' "
        "WHEN failed::DOUBLE / total < 0.15 THEN 'warning' ELSE 'critical' END AS verdict FROM (SELECT run, "
        "count(*) AS total, count(*) FILTER (WHERE success) AS clean, count(*) FILTER (WHERE NOT success AND failed) "
        "AS failed, round(avg(duration), 6) AS mean_ms, max(duration) AS max_ms FROM smp GROUP BY run)",
        smp=SAMPLES,
    ),
)
def _(s, d):
    return rounded(M.churn_verdict(samples(s, d).withColumnRenamed("success", "cleaned"), ["run"]), "mean_ms")


@query(
    "streaming_verdict",
    with_ctes(
        "ev",
        "SELECT * EXCLUDE (delta_mean_mb), round(delta_mean_mb, 6) AS delta_mean_mb, "
        "coalesce(large_ok::DOUBLE / nullif(large_total, 0), 0) AS large_rate, "
        "coalesce(small_ok::DOUBLE / nullif(small_total, 0), 0) AS small_rate, "
        "CASE WHEN delta_max_mb IS NULL THEN 'no data' WHEN delta_max_mb < 100 THEN 'excellent' "
        "WHEN delta_max_mb < 500 THEN 'warning' ELSE 'critical' END AS memory_band, "
        "CASE WHEN large_ok > 0 AND large_ok = large_total AND delta_max_mb < 100 THEN 'pass' "
        "WHEN large_ok > 0 AND large_ok = large_total THEN 'partial' ELSE 'fail' END AS verdict FROM (SELECT run, "
        "count(*) FILTER (WHERE large) AS large_total, count(*) FILTER (WHERE large AND success) AS large_ok, "
        "count(*) FILTER (WHERE NOT large) AS small_total, count(*) FILTER (WHERE NOT large AND success) AS small_ok, "
        "min(bytes) FILTER (WHERE large AND success) AS min_bytes, max(bytes) FILTER (WHERE large AND success) AS max_bytes, "
        "avg(duration) FILTER (WHERE large AND success) AS delta_mean_mb, "
        "max(duration) FILTER (WHERE large AND success) AS delta_max_mb "
        "FROM (SELECT *, bytes > 80 AS large FROM smp) GROUP BY run)",
        smp=SAMPLES,
    ),
)
def _(s, d):
    op = F.when(F.col("bytes") > 80, "upload_large").otherwise("upload_small")
    rows = samples(s, d).withColumn("op", op).withColumnRenamed("duration", "memory_delta_mb")
    return rounded(M.streaming_verdict(rows, ["run"]), "delta_mean_mb")


def containers(s, d):
    e = D.event_log(s, d)
    return e.select(
        (F.col("user_id") % 5).alias("container_name"),
        F.col("value").alias("memory_usage_mb"),
        F.col("k").cast("double").alias("cpu_percent"),
        "ts",
        F.col("event_id").alias("seq"),
    )


STATS = (
    "count(*) AS samples, min(value) AS memory_min, max(value) AS memory_max, round(avg(value), 6) AS memory_avg, "
    "min(k)::DOUBLE AS cpu_min, max(k)::DOUBLE AS cpu_max, round(avg(k), 6) AS cpu_avg"
)


@query("container_stats", with_ctes("ev", f"SELECT user_id % 5 AS container_name, {STATS} FROM ev GROUP BY 1"))
def _(s, d):
    return rounded(M.container_stats(containers(s, d)), "memory_avg", "cpu_avg")


@query(
    "solution_comparison",
    with_ctes("ev", f"SELECT event_type AS solution, memory_min, memory_max, memory_avg, cpu_avg FROM "
              f"(SELECT event_type, {STATS} FROM ev GROUP BY 1)"),
)
def _(s, d):
    e = D.event_log(s, d)
    rows = e.select(
        F.col("event_type").alias("solution"),
        F.col("value").alias("memory_usage_mb"),
        F.col("k").cast("double").alias("cpu_percent"),
    )
    return rounded(M.solution_comparison(rows), "memory_avg", "cpu_avg")


@query(
    "sample_average",
    with_ctes("ev", "SELECT user_id, round(avg(k), 6) AS mean, arg_min(k, seq) FILTER (WHERE k <> 0) AS first_nonzero, "
              "min(k) FILTER (WHERE k <> 0) AS min_nonzero FROM ev GROUP BY user_id"),
)
def _(s, d):
    return rounded(M.sample_average(D.event_log(s, d), ["user_id"], "k", "event_id"), "mean")


@query(
    "cold_start_split",
    with_ctes("ev", "SELECT user_id AS solution, count(*) AS starts, round(avg(k), 6) AS port_ms, round(avg(milli), 6) "
              "AS service_ms, round(avg(k + milli), 6) AS total_ms FROM ev GROUP BY user_id"),
)
def _(s, d):
    e = D.event_log(s, d)
    ms = F.unix_micros("ts")
    rows = e.select(
        F.col("user_id").alias("solution"),
        ms.alias("started_ms"),
        (ms + F.col("k")).alias("port_ready_ms"),
        (ms + F.col("k") + F.round(F.col("value") * 1000).cast("bigint")).alias("service_ready_ms"),
    )
    return rounded(M.cold_start_split(rows), "port_ms", "service_ms", "total_ms")


def run_metrics(s, d):
    """Long metrics per supplier as run: scaled averages in the range of the limits, some missing."""
    li = D.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(
        F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.max("l_quantity").alias("q"),
        F.min("l_linenumber").alias("ln"),
    )
    metric = lambda n, c: F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value"))
    return li.select(
        "run",
        F.inline(
            F.array(
                metric("memory_mb", F.col("lo") / 64),
                metric("cold_start_ms", F.when(F.col("run") % 3 > 0, F.col("hi") / 200)),
                metric("execution_p99_ms", F.col("q") * 2),
                metric("cache_p99_us", F.col("hi") / 100),
                metric("churn_cleanup_rate", F.col("q") * 1.9),
                metric("streaming_delta_mb", F.col("lo") / 10),
                metric("unlisted", F.col("lo")),
            )
        ),
    )


RUN_METRICS = (
    "SELECT run, metric, value FROM (SELECT l_suppkey AS run, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, "
    "max(l_quantity) AS q FROM lineitem GROUP BY 1), LATERAL (VALUES ('memory_mb', lo / 64, 20.0, 'le'), "
    "('cold_start_ms', CASE WHEN run % 3 > 0 THEN hi / 200 END, 500.0, 'le'), ('execution_p99_ms', q * 2, 100.0, 'le'), "
    "('cache_p99_us', hi / 100, 1000.0, 'le'), ('churn_cleanup_rate', q * 1.9::DOUBLE, 95.0, 'ge'), "
    "('streaming_delta_mb', lo / 10, 100.0, 'le')) t(metric, value, lim, dir)"
)
GATES = RUN_METRICS.replace(
    "SELECT run, metric, value FROM",
    'SELECT run, metric, value, lim::DOUBLE AS "limit", coalesce(CASE dir WHEN \'ge\' THEN value >= lim ELSE value <= lim '
    "END, true) AS passed, value IS NULL AS no_data FROM",
    1,
)


@query("threshold_gate", GATES)
def _(s, d):
    return M.threshold_gate(run_metrics(s, d))


@query("threshold_gate_compat", GATES.replace("value >= lim", "value <= lim"))
def _(s, d):
    return M.threshold_gate(run_metrics(s, d), compat=True)


@query(
    "overall_status",
    "SELECT run, CASE WHEN bool_or(NOT passed AND metric IN ('memory_mb', 'cold_start_ms', 'cache_p99_us', "
    "'execution_p99_ms')) THEN 'fail' WHEN count(*) FILTER (WHERE metric IN ('memory_mb', 'cold_start_ms') AND NOT no_data)"
    f" < 2 THEN 'partial' ELSE 'pass' END AS status FROM ({GATES}) GROUP BY run",
)
def _(s, d):
    return M.overall_status(M.threshold_gate(run_metrics(s, d)))


def yearly(s, d):
    """Largest price per part type and year: the metric two neighbouring runs are compared on."""
    li, p = D.table(s, d, "lineitem"), D.table(s, d, "part")
    # reduce by part before the join: one row per part and year meets the part table
    by_part = li.groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(
        F.max("l_extendedprice").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    return by_part.join(p, by_part.l_partkey == p.p_partkey).groupBy(F.col("p_type").alias("metric"), "year").agg(
        F.max("hi").alias("hi"), F.sum("n").alias("n")
    )


YEARLY = (
    "SELECT p_type AS metric, CAST(year(l_shipdate) AS INTEGER) AS year, max(l_extendedprice) AS hi, count(*) AS n "
    "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
)


@query(
    "baseline_compare",
    f"WITH y AS ({YEARLY}) SELECT *, CASE WHEN change_pct <= 5 THEN 'ok' WHEN abs(change_pct) <= 10 THEN 'warn' "
    "ELSE 'fail' END AS status FROM (SELECT c.metric, c.year, c.n::DOUBLE AS \"current\", b.n::DOUBLE AS baseline, "
    "(c.n - b.n)::DOUBLE / b.n * 100 AS change_pct FROM y c JOIN y b ON c.metric = b.metric AND c.year = b.year + 1)",
)
def _(s, d):
    y = yearly(s, d)
    now = y.select("metric", "year", F.col("n").cast("double").alias("value"))
    return M.baseline_compare(now, now.withColumn("year", F.col("year") + 1), ["metric", "year"])


@query(
    "release_compare",
    f"WITH y AS ({YEARLY}), r AS (SELECT metric, year + 1 AS year, hi, n FROM y) SELECT metric, year, release_mb, candidate_mb, "
    "change_pct, CASE WHEN change_pct <= 5 THEN 'ok' WHEN change_pct <= 15 THEN 'review' WHEN change_pct > 15 THEN 'fail' "
    "ELSE 'review' END AS status, image_trend FROM (SELECT metric, year, r.hi AS release_mb, y.hi AS candidate_mb, "
    "(y.hi - r.hi) / r.hi * 100 AS change_pct, CASE WHEN y.n > r.n THEN 'larger' WHEN y.n < r.n THEN 'smaller' "
    "WHEN y.n = r.n THEN 'unchanged' END AS image_trend FROM r FULL JOIN y USING (metric, year))",
)
def _(s, d):
    y = yearly(s, d).select("metric", "year", F.col("hi").alias("memory_mb"), F.col("n").cast("double").alias("image_mb"))
    return M.release_compare(y.withColumn("year", F.col("year") + 1), y, ["metric", "year"])


@query(
    "metrics_config_join",
    with_ctes(
        "ev",
        "SELECT m.run, container_name, memory, coalesce(CAST(c.o_orderpriority AS VARCHAR), 'N/A') AS mode, "
        "coalesce(CAST(c.o_custkey AS VARCHAR), 'N/A') AS blobs FROM (SELECT run, arg_min(container_name, seq) AS container_name, "
        "arg_min(memory, seq) AS memory FROM (SELECT user_id AS run, CASE event_type WHEN 'click' THEN 'Server-' || k "
        "WHEN 'view' THEN 'Frontend-' || k ELSE 'worker-' || k END AS container_name, value AS memory, seq FROM ev) "
        "WHERE container_name NOT LIKE 'worker%' GROUP BY run) m LEFT JOIN orders c "
        "ON CASE WHEN c.o_orderstatus = 'O' THEN -c.o_orderkey ELSE c.o_orderkey END = m.run",
    ),
)
def _(s, d):
    e = D.event_log(s, d)
    name = (
        F.when(F.col("event_type") == "click", "Server-").when(F.col("event_type") == "view", "Frontend-").otherwise("worker-")
    )
    metrics = e.select(
        F.col("user_id").alias("run"),
        F.concat(name, F.col("k").cast("string")).alias("container_name"),
        F.col("value").alias("memory"),
        F.col("event_id").alias("position"),
    )
    # open orders configure runs that have no metrics
    run = F.when(F.col("o_orderstatus") == "O", -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    config = D.table(s, d, "orders").select(run.alias("run"), F.col("o_orderpriority").alias("mode"), F.col("o_custkey").alias("blobs"))
    return M.metrics_config_join(metrics, config)


@query(
    "counter_rate",
    with_ctes(
        "ev",
        "SELECT container_name, epoch_us(step) + (sh + 1) * 5000000 AS window_end_us, round(sum(grown) / 60.0::DOUBLE * 100, 6) "
        "AS rate FROM (SELECT container_name, time_bucket(INTERVAL '5 seconds', ts) AS step, "
        "CASE WHEN k >= b THEN k - b ELSE k END AS grown "
        "FROM (SELECT user_id % 5 AS container_name, ts, k, lag(k) OVER (PARTITION BY user_id % 5 ORDER BY ts, k) AS b FROM ev) "
        "WHERE b IS NOT NULL), generate_series(0, 11) g(sh) GROUP BY container_name, 2",
    ),
)
def _(s, d):
    e = D.event_log(s, d).select((F.col("user_id") % 5).alias("container_name"), "ts", "k")
    out = M.counter_rate(e, ["container_name"], "k", "ts")
    return rounded(out.select("container_name", F.unix_micros("window_end").alias("window_end_us"), "rate"), "rate")


def container_lines(s, d):
    """Raw lines as a container tool prints them; one event type yields lines that cannot be read."""
    e = D.event_log(s, d)
    k, v = F.col("k").cast("string"), F.col("value").cast("string")
    unit = F.when(F.col("k") % 3 == 0, "KiB").when(F.col("k") % 3 == 1, "MiB").otherwise("GB")
    good = F.concat(
        k, F.lit(".5%|"), v, unit, F.lit(" / 512MiB|"), k, F.lit("%|"), k, F.lit("kB / "), k, F.lit("|0B / 2TB|"), k
    )
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("oops|"), k)).otherwise(good)
    return e.select(F.col("event_id").alias("seq"), line.alias("line"))


@query(
    "sample_normalize",
    with_ctes(
        "ev",
        "SELECT seq, k + 0.5::DOUBLE AS cpu_percent, k::DOUBLE AS memory_percent, CAST(k AS INTEGER) AS pids, "
        "round(value * CASE k % 3 WHEN 0 THEN 1.0::DOUBLE / 1024 WHEN 1 THEN 1 ELSE 1024 END, 6) AS memory_usage_mb, "
        "512.0::DOUBLE AS memory_limit_mb, round(k / 1024.0::DOUBLE, 6) AS net_io_read_mb, "
        "round(k / 1048576.0::DOUBLE, 9) AS net_io_write_mb, 0.0::DOUBLE AS block_io_read_mb, "
        "2097152.0::DOUBLE AS block_io_write_mb FROM ev WHERE event_type <> 'error'",
    ),
)
def _(s, d):
    good, _bad = M.sample_normalize(container_lines(s, d))
    out = rounded(good.drop("line"), "memory_usage_mb", "net_io_read_mb")
    return rounded(out, "net_io_write_mb", digits=9)


@query("sample_rejects", with_ctes("ev", "SELECT seq, 'oops|' || k AS line FROM ev WHERE event_type = 'error'"))
def _(s, d):
    return M.sample_normalize(container_lines(s, d))[1]
