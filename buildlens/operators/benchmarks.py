"""Benchmark analytics: latency distributions, verdicts, gates, comparisons, container statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens import schemas as S
from buildlens.plans import ranks as R
from buildlens.plans.ordered import null_safe_join


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def latency_summary(samples: DataFrame, keys: list[str], value: str = "duration") -> DataFrame:
    """Distribution of the successful samples per group; a group without any gets zeros.

    Median and percentiles are exact and never order a whole group in one task.
    """
    ok = F.coalesce(F.col("success"), F.lit(False)) & F.col(value).isNotNull()
    v = F.when(ok, F.col(value))
    base = samples.groupBy(*keys).agg(
        F.count(v).alias("n"),
        *[f(v).alias(name) for name, f in
          (("min", F.min), ("max", F.max), ("mean", F.avg), ("stddev", F.stddev_samp))],
    )
    n = F.col("n")
    wanted = R.group_positions(
        base,
        keys,
        "n",
        {
            "low_mid": F.floor((n - 1) / 2),
            "high_mid": F.floor(n / 2),
            "p95": R.nearest_rank_position(n, 95),
            "p99": R.nearest_rank_position(n, 99),
        },
    )
    found = R.values_at(samples.filter(ok), keys, value, wanted)
    wide = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in ("low_mid", "high_mid", "p95", "p99")]
    )
    zero = F.lit(0.0)
    return null_safe_join(base, wide, keys).select(
        *keys,
        "n",
        *[F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in ("min", "max", "mean")],
        F.coalesce((F.col("low_mid") + F.col("high_mid")) / 2.0, zero).alias("median"),
        *[F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in ("p95", "p99", "stddev")],
    )


def serial_throughput(samples: DataFrame, keys: list[str], value: str = "duration", per_second: float = 1000.0):
    """Successful samples per second of summed latency: a per-request rate, blind to concurrency."""
    ok = samples.filter(F.col("success"))
    total = F.sum(value)
    return ok.groupBy(*keys).agg(
        F.coalesce(F.when(total > 0, F.count(F.lit(1)) * F.lit(per_second) / total), F.lit(0.0)).alias("per_second")
    )


def rates(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Hit rate over successes, success rate over all, bytes moved by successes."""
    ok = F.col("success")
    successes, hits = _count(ok), _count(ok & F.col("hit"))
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        successes.alias("successes"),
        hits.alias("hits"),
        F.when(successes > 0, hits / successes).otherwise(F.lit(0.0)).alias("hit_rate"),
        (successes / F.count(F.lit(1))).alias("success_rate"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes_moved"),
    )


def stampede_verdict(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of hits, misses and errors, and how far the 99th percentile lies above the mean."""
    failed = F.col("error").isNotNull()
    base = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        _count(F.col("hit")).alias("hits"),
        _count(~F.col("hit") & ~failed).alias("misses"),
        _count(failed).alias("errors"),
        F.avg(F.when(~failed, F.col("duration"))).alias("mean"),
    )
    p99 = R.nearest_rank(samples.filter(~failed), keys, "duration", [99]).select(*keys, F.col("value").alias("p99"))
    ratio = F.when(F.col("mean") > 0, F.col("p99") / F.col("mean")).otherwise(F.lit(0.0))
    verdict = (
        F.when(F.col("p99").isNull(), "no data")
        .when((F.col("ratio") < 2.0) & (F.col("errors") == 0), "excellent")
        .when((F.col("ratio") < 3.0) & (F.col("errors") < F.col("total") * 0.01), "good")
        .when(F.col("errors") > F.col("total") * 0.05, "critical")
        .otherwise("warning")
    )
    return null_safe_join(base, p99, keys).withColumn("ratio", ratio).withColumn("verdict", verdict)


def blocking_score(timings: DataFrame, keys: list[str]) -> DataFrame:
    """Queue and total time of fast and slow actions; bands on the fast average."""

    def positive(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c))

    stats = [
        f(positive(c)).alias(f"{c}_{name}")
        for c in ("queue_ms", "total_ms")
        for name, f in (("min", F.min), ("avg", F.avg), ("max", F.max))
    ]
    out = timings.groupBy(*keys, "action_class").agg(F.count(F.lit(1)).alias("actions"), *stats)
    fast = (F.col("action_class") == "fast") & F.col("total_ms_avg").isNotNull()
    avg = F.col("total_ms_avg")
    return out.withColumns(
        {
            "latency_band": F.when(
                fast, F.when(avg < 500, "excellent").when(avg < 2000, "warning").otherwise("critical")
            ),
            "blocking_band": F.when(
                fast, F.when(avg < 200, "none").when(avg < 1000, "minimal").otherwise("significant")
            ),
        }
    )


def churn_verdict(samples: DataFrame, keys: list[str]) -> DataFrame:
    d = F.when(F.col("duration") > 0, F.col("duration"))
    out = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        _count(F.col("cleaned")).alias("clean"),
        _count(~F.col("cleaned") & F.col("error").isNotNull()).alias("failed"),
        F.avg(d).alias("mean_ms"),
        F.max(d).alias("max_ms"),
    )
    share = F.col("failed") / F.col("total")
    return out.withColumn(
        "verdict",
        F.when(F.col("failed") == 0, "excellent")
        .when(share < 0.05, "good")
        .when(share < 0.15, "warning")
        .otherwise("critical"),
    )


def streaming_verdict(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Large and small transfers apart; memory growth of the large ones decides."""
    large, ok = F.contains("op", F.lit("large")), F.col("success")
    small = F.contains("op", F.lit("small"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = samples.groupBy(*keys).agg(
        _count(large).alias("large_total"),
        _count(large & ok).alias("large_ok"),
        _count(small).alias("small_total"),
        _count(small & ok).alias("small_ok"),
        F.min(F.when(large & ok, F.col("bytes"))).alias("min_bytes"),
        F.max(F.when(large & ok, F.col("bytes"))).alias("max_bytes"),
        F.avg(F.when(large & ok, F.col("memory_delta_mb"))).alias("delta_mean_mb"),
        F.max(F.when(large & ok, F.col("memory_delta_mb"))).alias("delta_max_mb"),
    )
    top = F.col("delta_max_mb")
    all_ok = (F.col("large_ok") > 0) & (F.col("large_ok") == F.col("large_total"))
    return out.withColumns(
        {
            "large_rate": rate(F.col("large_ok"), F.col("large_total")),
            "small_rate": rate(F.col("small_ok"), F.col("small_total")),
            "memory_band": F.when(top.isNull(), "no data")
            .when(top < 100, "excellent")
            .when(top < 500, "warning")
            .otherwise("critical"),
            "verdict": F.when(all_ok & (top < 100), "pass").when(all_ok, "partial").otherwise("fail"),
        }
    )


def container_stats(samples: DataFrame, key: str = "container_name") -> DataFrame:
    return samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("samples"),
        *[
            f(c).alias(f"{short}_{name}")
            for c, short in (("memory_usage_mb", "memory"), ("cpu_percent", "cpu"))
            for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg))
        ],
    )


def solution_comparison(samples: DataFrame, key: str = "solution") -> DataFrame:
    stats = container_stats(samples, key)
    return stats.select(key, "memory_min", "memory_max", "memory_avg", "cpu_avg")


def sample_average(samples: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Mean of the samples, the first that is not zero, and the smallest that is not zero."""
    nonzero = F.col(value) != 0
    return samples.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.min_by(value, F.when(nonzero, F.col(order))).alias("first_nonzero"),
        F.min(F.when(nonzero, F.col(value))).alias("min_nonzero"),
    )


def cold_start_split(starts: DataFrame, key: str = "solution") -> DataFrame:
    """Start-up time up to the open port, and from there to the first served call."""
    port = F.col("port_ready_ms") - F.col("started_ms")
    service = F.col("service_ready_ms") - F.col("port_ready_ms")
    return starts.groupBy(key).agg(
        F.count(F.lit(1)).alias("starts"),
        F.avg(port).alias("port_ms"),
        F.avg(service).alias("service_ms"),
        F.avg(port + service).alias("total_ms"),
    )


def gate_limits(spark) -> DataFrame:
    return spark.createDataFrame(S.GATE_LIMITS, "metric string, `limit` double, unit string, direction string")


def threshold_gate(metrics: DataFrame, compat: bool = False) -> DataFrame:
    """Long metrics (run, metric, value) against the six limits; a missing value passes as "no data".

    ``compat`` tests the clean-up rate as an upper bound as well, like the original gate.
    """
    limits = F.broadcast(gate_limits(metrics.sparkSession))  # six fixed rows
    value, limit = F.col("value"), F.col("limit")
    within = value <= limit
    if not compat:
        within = F.when(F.col("direction") == "ge", value >= limit).otherwise(within)
    return metrics.join(limits, "metric").select(
        "run", "metric", "value", "limit", F.coalesce(within, F.lit(True)).alias("passed"), value.isNull().alias("no_data")
    )


def overall_status(gates: DataFrame) -> DataFrame:
    """One verdict per run: four metrics can fail it, two make it partial when missing; clean-up has no say."""
    decisive = F.col("metric").isin("memory_mb", "cold_start_ms", "cache_p99_us", "execution_p99_ms")
    essential = F.col("metric").isin("memory_mb", "cold_start_ms")
    return (
        gates.groupBy("run")
        .agg(
            F.coalesce(F.bool_or(F.when(decisive, ~F.col("passed"))), F.lit(False)).alias("failed"),
            F.count_if(essential & ~F.col("no_data")).alias("essential_present"),
        )
        .select(
            "run",
            F.when(F.col("failed"), "fail").when(F.col("essential_present") < 2, "partial").otherwise("pass").alias("status"),
        )
    )


def change_percent(current: Column, baseline: Column) -> Column:
    return F.when(baseline != 0, (current - baseline) / baseline * 100).otherwise(F.lit(0.0))


def baseline_compare(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Current against baseline values; metrics without a value on either side are left out."""
    b = baseline.select(*keys, F.col("value").alias("baseline"))
    out = current.select(*keys, F.col("value").alias("current")).join(b, keys)
    out = out.filter(F.col("current").isNotNull() & F.col("baseline").isNotNull())
    c = F.col("change_pct")
    return out.withColumn("change_pct", change_percent(F.col("current"), F.col("baseline"))).withColumn(
        "status", F.when(c <= 5, "ok").when(F.abs(c) <= 10, "warn").otherwise("fail")
    )


def release_compare(release: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Memory of a candidate against the release, with the image size trend.

    A missing or zero value on either side leaves the change open and asks for a review.
    """
    r = release.select(*keys, F.col("memory_mb").alias("release_mb"), F.col("image_mb").alias("release_image"))
    c = candidate.select(*keys, F.col("memory_mb").alias("candidate_mb"), F.col("image_mb").alias("candidate_image"))
    both = (F.coalesce("release_mb", F.lit(0.0)) != 0) & (F.coalesce("candidate_mb", F.lit(0.0)) != 0)
    change = F.when(both, change_percent(F.col("candidate_mb"), F.col("release_mb")))
    known = (F.coalesce("release_image", F.lit(0.0)) != 0) & (F.coalesce("candidate_image", F.lit(0.0)) != 0)
    trend = (
        F.when(F.col("candidate_image") > F.col("release_image"), "larger")
        .when(F.col("candidate_image") < F.col("release_image"), "smaller")
        .otherwise("unchanged")
    )
    return r.join(c, keys, "full").select(
        *keys,
        "release_mb",
        "candidate_mb",
        change.alias("change_pct"),
        F.when(change <= 5, "ok").when(change <= 15, "review").when(change > 15, "fail").otherwise("review").alias("status"),
        F.when(known, trend).alias("image_trend"),
    )


def metrics_config_join(metrics: DataFrame, config: DataFrame, order: str = "position") -> DataFrame:
    """First server or front-end container per run, with the run's configuration or ``N/A``."""
    name = F.lower("container_name")
    served = metrics.filter(F.contains(name, F.lit("server")) | F.contains(name, F.lit("frontend")))
    values = [c for c in metrics.columns if c not in ("run", order)]
    first = served.groupBy("run").agg(F.min_by(F.struct(*values), F.col(order)).alias("m"))
    out = first.select("run", "m.*").join(config, "run", "left")
    settings = [c for c in config.columns if c != "run"]
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in settings})


def counter_rate(samples: DataFrame, keys: list[str], counter: str, ts: str, **options) -> DataFrame:
    """Rate per second of a counter over one-minute windows every five seconds, times 100.

    A drop counts as a reset, and the value after it as the growth. Growth is summed per five-second step first,
    so that only one row per step enters the twelve windows that cover it. Windows are not extrapolated.
    """
    from buildlens.plans.ordered import previous

    seen = previous(samples, keys, [ts, counter], {"before": counter}, **options)
    grown = F.when(F.col(counter) >= F.col("before"), F.col(counter) - F.col("before")).otherwise(F.col(counter))
    steps = (
        seen.filter(F.col("before").isNotNull())
        .groupBy(*keys, F.window(ts, "5 seconds").alias("step"))
        .agg(F.sum(grown).alias("grown"))
    )
    shifts = F.explode(F.sequence(F.lit(0), F.lit(11)))
    windows = steps.select(*keys, "grown", "step", shifts.alias("shift")).withColumn(
        "window_end", F.timestamp_micros(F.unix_micros("step.end") + F.col("shift") * F.lit(5_000_000))
    )
    return windows.groupBy(*keys, "window_end").agg((F.sum("grown") / 60 * 100).alias("rate"))


def sample_normalize(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw container lines -> typed samples, and the lines that are none."""
    from buildlens.functions.exprs import megabytes

    # A generator's column is computed once a row; a plain one would be put into each expression of the filters again, and
    # with it all that the line itself is made from.
    cut = lines.select("*", F.explode(F.array(F.split("line", r"\|"))).alias("_parts"))
    part = lambda i: F.try_element_at("_parts", F.lit(i))
    pair = lambda i, j: F.try_element_at(F.split(part(i), "/"), F.lit(j))
    percent = lambda i: F.trim(F.regexp_replace(part(i), "%", "")).try_cast("double")
    sizes = {
        "memory_usage_mb": pair(2, 1),
        "memory_limit_mb": pair(2, 2),
        "net_io_read_mb": pair(4, 1),
        "net_io_write_mb": pair(4, 2),
        "block_io_read_mb": pair(5, 1),
        "block_io_write_mb": pair(5, 2),
    }
    numbers = {"cpu_percent": percent(1), "memory_percent": percent(3), "pids": F.trim(part(6)).try_cast("int")}
    # a size that is there always has a number of megabytes
    bad = F.greatest(*[c.isNull() for c in (numbers | sizes).values()])
    out = cut.withColumns(numbers | {n: F.when(c.isNotNull(), megabytes(c)) for n, c in sizes.items()})
    return out.filter(~bad).drop("_parts"), cut.filter(bad).select(*lines.columns)
