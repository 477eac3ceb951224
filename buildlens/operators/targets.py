"""Target and test analytics: executions, rollups, histories, searches, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens import schemas as S
from buildlens.functions import exprs as X


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def target_executions(
    completions: DataFrame,
    kinds: DataFrame,
    metrics: DataFrame,
    summary: DataFrame | None = None,
    env: DataFrame | None = None,
) -> DataFrame:
    """Completion events with kind, action metrics, build times and environment; missing sides get defaults.

    ``kinds`` is keyed by label, or by build and label where the log holds configuration events. Rollups need
    neither the build's times nor its environment and leave those joins out.
    """
    kind_keys = [k for k in ("invocation_id", "label") if k in kinds.columns]
    out = completions.join(metrics, ["invocation_id", "label"], "left").join(kinds, kind_keys, "left")
    if summary is not None:
        times = summary.select(
            "invocation_id",
            F.col("start_time").alias("build_start_time"),
            F.col("end_time").alias("build_end_time"),
            F.col("duration_ms").alias("build_duration_ms"),
        )
        out = out.join(times, "invocation_id", "left")
    if env is not None:
        out = out.join(env, "invocation_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in
            ("action_duration_ms", "action_count", "cached_actions", "failed_actions")}
    return out.withColumns(zero).withColumns(
        {
            "target_kind": F.coalesce("target_kind", F.lit("")),
            "status": F.when(F.coalesce("success", F.lit(False)), "success").otherwise("failure"),
        }
    )


def test_executions(results: DataFrame) -> DataFrame:
    """Test results as records, with the status code spelled out and the attempt's times kept."""
    rest = [c for c in ("sequence_number", "ingest_order") if c in results.columns]
    return results.select(
        "label",
        "invocation_id",
        X.test_status_name(F.col("test_status")).alias("status"),
        F.coalesce("cached_locally", F.lit(False)).alias("cached_locally"),
        F.coalesce("cached_remotely", F.lit(False)).alias("cached_remotely"),
        "start_ts",
        F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"),
        *rest,
    )


def target_rollup(executions: DataFrame, order: str = "ingest_order") -> DataFrame:
    """One row per label. Tags are made distinct before they are gathered."""
    at = F.col(order)
    base = executions.groupBy("label").agg(
        F.coalesce(
            F.min_by("target_kind", F.when(F.col("target_kind") != "", at)), F.lit("")
        ).alias("target_kind"),
        F.max_by("status", at).alias("latest_status"),
        F.count(F.lit(1)).alias("total_executions"),
        _count(F.col("status") == "success").alias("success_count"),
        _count(F.col("status") == "failure").alias("failure_count"),
        _count(F.col("status") == "cached").alias("cached_count"),
        F.sum("action_count").alias("action_count"),
        F.sum("cached_actions").alias("cached_actions"),
        F.sum("failed_actions").alias("failed_actions"),
    )
    tags = distinct_ordered(executions, "label", "tags", order)
    return base.join(tags, "label", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def distinct_ordered(df: DataFrame, key: str, items: str, order: str) -> DataFrame:
    """Distinct array items per key in first-seen order. Equal arrays of a key are reduced to the first of them before items
    are taken apart (the place within it is the same in all), and items to one row each before gathering."""
    arrays = df.groupBy(key, items).agg(F.min(order).alias(order))
    seen = (
        arrays.select(key, order, F.posexplode(items).alias("pos", "item"))
        .groupBy(key, "item")
        .agg(F.min(F.struct(order, "pos")).alias("at"))
    )
    return seen.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias(items)
    )


def test_rollup(executions: DataFrame, order: str = "ingest_order") -> DataFrame:
    s = F.col("status")
    return executions.groupBy("label").agg(
        F.coalesce(F.max_by("status", F.col(order)), F.lit("NO_STATUS")).alias("latest_status"),
        F.count(F.lit(1)).alias("total_runs"),
        _count(s == "PASSED").alias("passed_count"),
        _count(s.isin(S.FAILED_TEST_STATUSES)).alias("failed_count"),
        _count(F.col("cached_locally") | F.col("cached_remotely")).alias("cached_count"),
        _count(s == "FLAKY").alias("flaky_count"),
    )


def ranked(rollup: DataFrame, count: str) -> DataFrame:
    """Most executions first, label breaks ties."""
    return rollup.orderBy(F.col(count).desc(), F.col("label"))


def target_search(rollup: DataFrame, query: str = "", status: str | None = None) -> DataFrame:
    hit = X.contains_text(F.col("label"), query) | X.contains_text(F.col("target_kind"), query)
    return rollup.filter(hit if status is None else hit & (F.col("latest_status") == status))


def test_search(rollup: DataFrame, query: str) -> DataFrame:
    return rollup.filter(X.contains_text(F.col("label"), query))


def history(executions: DataFrame, labels: DataFrame, order: str = "ingest_order") -> DataFrame:
    """Executions of the given labels in append order."""
    return executions.join(labels.select("label").distinct(), "label", "left_semi").orderBy("label", order)


def build_targets(executions: DataFrame, ids: DataFrame) -> DataFrame:
    """Target executions of the given builds, ordered by label."""
    wanted = ids.select("invocation_id").distinct()
    return executions.join(wanted, "invocation_id", "left_semi").orderBy("invocation_id", "label")


def test_status_mix(executions: DataFrame) -> DataFrame:
    """Runs per status group: pass, fail, flaky, other."""
    s = F.col("status")
    group = F.when(s == "PASSED", "pass").when(s.isin(S.FAILED_TEST_STATUSES), "fail").when(s == "FLAKY", "flaky")
    return executions.groupBy(group.otherwise("other").alias("status_group")).agg(F.count(F.lit(1)).alias("runs"))


def latest_env(executions: DataFrame, order: str = "ingest_order") -> DataFrame:
    """Environment of each label's latest execution as rows.

    Only the build of the latest execution is aggregated per label; its map is fetched by a join afterwards when
    ``env_vars`` is not already on the row.
    """
    last = executions.groupBy("label").agg(F.max_by("env_vars", F.col(order)).alias("env_vars"))
    return last.select("label", F.explode("env_vars").alias("key", "value"))


def latest_status(executions: DataFrame, order: str = "ingest_order") -> DataFrame:
    return executions.groupBy("label").agg(F.max_by("status", F.col(order)).alias("latest_status"))


def duration_timeline(executions: DataFrame) -> DataFrame:
    """Bar length per execution: action time, else build time, as a share of the label's longest, at least 2 %."""
    bar = F.when(F.col("action_duration_ms") > 0, F.col("action_duration_ms")).otherwise(
        F.coalesce("build_duration_ms", F.lit(0))
    )
    rows = executions.withColumn("bar_ms", bar)
    longest = rows.groupBy("label").agg(F.greatest(F.max("bar_ms"), F.lit(1)).alias("longest_ms"))
    return rows.join(longest, "label").withColumn(
        "width_percent", F.greatest(F.lit(100.0) * F.col("bar_ms") / F.col("longest_ms"), F.lit(2.0))
    )
