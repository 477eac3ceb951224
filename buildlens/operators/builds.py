"""Build-event analytics: summaries, action metrics, misses, statistics, build pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions import exprs as X

SEQ = "sequence_number"


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _newest(value: str | Column, when: Column) -> Column:
    """Value of the latest event that satisfies ``when``."""
    return F.max_by(value, F.when(when, F.col(SEQ)))


def _succeeded() -> Column:
    return F.coalesce(F.col("overall_success"), F.lit(False)) | F.coalesce(F.col("exit_code") == 0, F.lit(False))


def targets_seen(events: DataFrame) -> DataFrame:
    """Distinct labels per build with the position at which each was first seen."""
    named = events.filter(F.col("kind").isin("ActionExecuted", "TargetComplete") & (F.col("label") != ""))
    return named.groupBy("invocation_id", "label").agg(F.min(SEQ).alias("first_seq"))


# Kinds of events a summary is made from.
_SUMMARY_KINDS = ["BuildStarted", "BuildFinished", "BuildMetrics", "ActionExecuted", "TestResult", "TestSummary"]


def build_summary(
    events: DataFrame, compat: bool = False, targets: bool = True, other_kinds: bool = True, errors: bool = False
) -> DataFrame:
    """Fold the flat events of each invocation into one row.

    The few events that open and close a build give its text fields; actions and tests, which are nearly all
    events, only feed counters, so they go through a hash aggregate that combines before the shuffle. Test hits
    that follow the last metrics event need that event's position and are counted apart, over remote test hits
    only. The target list is collected from labels already made distinct.

    ``errors`` adds the failure details in the order of their events (equal positions by text); events need the column
    ``failure_detail`` for it. ``build_errors`` has them as rows, for builds with more than a row should hold.

    ``compat`` adds cached tests to ``cached_actions`` as the original reports do, which can exceed the total.
    """
    finished = _is("BuildFinished")
    status = F.when(_is("BuildStarted"), "in_progress").when(finished, F.when(_succeeded(), "success").otherwise("failure"))
    metrics = F.col("remote_cache_hits").isNotNull() & _is("BuildMetrics")
    frame = (
        events.filter(F.col("kind").isin("BuildStarted", "BuildFinished", "BuildMetrics"))
        .groupBy("invocation_id")
        .agg(
            _newest("command", _is("BuildStarted")).alias("command"),
            _newest("workspace", _is("BuildStarted")).alias("workspace"),
            _newest("start_time", _is("BuildStarted") & F.col("start_time").isNotNull()).alias("start_time"),
            _newest("end_time", finished & F.col("end_time").isNotNull()).alias("end_time"),
            _newest(status, status.isNotNull()).alias("status"),
            _newest("remote_cache_hits", metrics).alias("metric_hits"),
        )
    )
    action = _is("ActionExecuted")
    success = action & F.col("success")
    cached = success & X.same_instant(F.col("start_time"), F.col("end_time"))
    counters = {
        "total_actions": _count(action),
        "cached_only_actions": _count(cached),
        "ok_actions": _count(success),
        "cached_test_results": _count(_is("TestResult") & F.col("cached_locally")),
        "cached_test_runs": F.coalesce(F.sum(F.when(_is("TestSummary"), F.col("total_num_cached"))), F.lit(0)),
    }
    counted = (
        events.filter(F.col("kind").isin("ActionExecuted", "TestResult", "TestSummary"))
        .groupBy("invocation_id")
        .agg(*[c.alias(n) for n, c in counters.items()])
    )
    rest = events.filter(~F.col("kind").isin(_SUMMARY_KINDS)).select("invocation_id").distinct()
    out = frame.join(counted, "invocation_id", "full").withColumns(
        {n: F.coalesce(n, F.lit(0)) for n in counters} | {"status": F.coalesce("status", F.lit("in_progress"))}
    )
    if other_kinds:
        # an invocation may have sent nothing but other events so far
        only_rest = rest.join(out.select("invocation_id"), "invocation_id", "left_anti")
        only_rest = only_rest.withColumns(
            {"status": F.lit("in_progress")} | {n: F.lit(0).cast("bigint") for n in counters}
        )
        out = out.unionByName(only_rest, allowMissingColumns=True)
    position = (
        events.filter(metrics).groupBy("invocation_id").agg(F.max(SEQ).alias("metric_seq"))
    )
    remote_tests = events.filter(_is("TestResult") & F.col("cached_remotely")).select("invocation_id", SEQ)
    after = (
        remote_tests.join(position, "invocation_id", "left")
        .filter(F.col("metric_seq").isNull() | (F.col(SEQ) > F.col("metric_seq")))
        .groupBy("invocation_id")
        .agg(F.count(F.lit(1)).alias("later_hits"))
    )
    out = out.join(after, "invocation_id", "left")
    if targets:
        listed = (
            targets_seen(events)
            .groupBy("invocation_id")
            .agg(F.array_sort(F.collect_list(F.struct("first_seq", "label"))).alias("_seen"))
        )
        out = out.join(
            listed.select("invocation_id", F.transform("_seen", lambda x: x["label"]).alias("targets")),
            "invocation_id",
            "left",
        ).withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    if errors:
        told = build_errors(events).groupBy("invocation_id").agg(F.array_sort(F.collect_list(F.struct(SEQ, "error"))).alias("_told"))
        listed = told.select("invocation_id", F.transform("_told", lambda x: x["error"]).alias("errors"))
        out = out.join(listed, "invocation_id", "left")
        out = out.withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
    start, end = X.instant(F.col("start_time")), X.instant(F.col("end_time"))
    cached_total = F.col("cached_only_actions")
    if compat:
        cached_total = cached_total + F.col("cached_test_results") + F.col("cached_test_runs")
    return out.select(
        "invocation_id",
        "command",
        "workspace",
        "start_time",
        "end_time",
        F.coalesce(X.span_ms(start, end), F.when(X.skewed(start, end), None).otherwise(F.lit(0))).alias("duration_ms"),
        X.skewed(start, end).alias("clock_skew"),
        "status",
        "total_actions",
        cached_total.alias("cached_actions"),
        (F.col("ok_actions") - F.col("cached_only_actions")).alias("local_actions"),
        (F.col("total_actions") - F.col("ok_actions")).alias("failed_actions"),
        (F.coalesce("metric_hits", F.lit(0)) + F.coalesce("later_hits", F.lit(0))).alias("remote_cache_hits"),
        "cached_test_results",
        "cached_test_runs",
        *(["targets"] if targets else []),
        *(["errors"] if errors else []),
    )


def build_errors(events: DataFrame) -> DataFrame:
    """Failure details, one row each: what failed builds and failed targets reported. The long form of ``errors``."""
    failed = (_is("BuildFinished") & ~_succeeded()) | (_is("TargetComplete") & ~F.coalesce("success", F.lit(False)))
    return events.filter(failed & F.col("failure_detail").isNotNull()).select(
        "invocation_id", SEQ, F.col("failure_detail").alias("error")
    )


def read_side_defaults(summary: DataFrame, wanted: DataFrame) -> DataFrame:
    """Summaries for the wanted ids; an id without one gets the default in-progress row."""
    counters = [c for c in ("total_actions", "cached_actions", "local_actions", "failed_actions", "duration_ms",
                            "remote_cache_hits") if c in summary.columns]
    out = wanted.join(summary, "invocation_id", "left")
    return out.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in counters}
        | {"status": F.coalesce("status", F.lit("in_progress"))}
    )


def build_lookup(builds: DataFrame, ids: DataFrame) -> DataFrame:
    """The builds with the given ids; an unknown id yields no row."""
    return builds.join(ids.select("invocation_id").distinct(), "invocation_id", "left_semi")


def build_events(events: DataFrame, ids: DataFrame) -> DataFrame:
    """All events of the given builds in arrival order."""
    return build_lookup(events, ids).orderBy("invocation_id", SEQ)


def builds_recent(builds: DataFrame) -> DataFrame:
    """Newest first by the text of the start time; builds without one last."""
    return builds.orderBy(F.col("start_time").desc_nulls_last(), F.col("invocation_id").desc())


def dashboard_recent(builds: DataFrame, n: int = 10) -> DataFrame:
    return builds_recent(builds).limit(n)


def cache_hit_ratio(summary: DataFrame) -> DataFrame:
    return summary.select(
        "invocation_id", X.percent_half_up(F.col("cached_actions"), F.col("total_actions")).alias("hit_percent")
    )


def global_stats(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("total_builds"),
        _count(F.col("status") == "in_progress").alias("in_progress_builds"),
        _count(F.col("status") == "success").alias("successful_builds"),
        _count(F.col("status") == "failure").alias("failed_builds"),
        F.coalesce(F.sum("total_actions"), F.lit(0)).alias("total_actions"),
        F.coalesce(F.sum("failed_actions"), F.lit(0)).alias("failed_actions"),
    )


def metric_hit() -> Column:
    """Cached by the metrics rule: the spawn flag, else success within the same millisecond with a start."""
    start, end = F.col("start_ts"), F.col("end_ts")
    instant = F.col("success") & (F.coalesce(X.span_ms(start, end), F.lit(0)) == 0) & start.isNotNull()
    return F.coalesce(F.col("spawn_cache_hit"), F.lit(False)) | (F.coalesce(instant, F.lit(False)) & ~X.skewed(start, end))


def action_metrics(actions: DataFrame) -> DataFrame:
    """Counts and summed time per build and label; blank labels are skipped."""
    return (
        actions.filter(F.col("label") != "")
        .groupBy("invocation_id", "label")
        .agg(
            F.count(F.lit(1)).alias("action_count"),
            F.coalesce(F.sum(X.span_ms(F.col("start_ts"), F.col("end_ts"))), F.lit(0)).alias("action_duration_ms"),
            _count(metric_hit()).alias("cached_actions"),
            _count(~F.coalesce(F.col("success"), F.lit(False))).alias("failed_actions"),
        )
    )


def cache_misses(actions: DataFrame) -> DataFrame:
    """Actions that really ran: all but successes whose start and end texts are equal. Map-only."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return actions.filter(~(ok & X.same_instant(F.col("start_time"), F.col("end_time")))).select(
        "invocation_id",
        F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("action_type", F.lit("")).alias("type"),
        ok.alias("success"),
        F.lit(False).alias("cached"),
        "exit_code",
        X.span_ms(F.col("start_ts"), F.col("end_ts")).alias("duration_ms"),
        F.col("id").alias("event_id"),
    )


def miss_search(misses: DataFrame, query: str) -> DataFrame:
    return misses.filter(X.contains_text(F.col("label"), query) | X.contains_text(F.col("type"), query))


def cache_rule_audit(actions: DataFrame) -> DataFrame:
    """How often the three cache-hit rules agree, as counts per combination.

    The summary rule compares instants to the nanosecond, the miss rule compares the texts.
    """
    ok = F.coalesce(F.col("success"), F.lit(False))
    same_text = X.same_instant(F.col("start_time"), F.col("end_time"))
    same_nanos = F.coalesce(
        (F.col("start_ts") == F.col("end_ts"))
        & (X.fraction_digits(F.col("start_time")) == X.fraction_digits(F.col("end_time"))),
        F.lit(False),
    )
    return (
        actions.select(
            (ok & same_nanos).alias("summary_rule"),
            metric_hit().alias("metrics_rule"),
            (ok & same_text).alias("miss_rule"),
        )
        .groupBy("summary_rule", "metrics_rule", "miss_rule")
        .agg(F.count(F.lit(1)).alias("actions"))
    )


# Prefixes of the flags that set the environment of actions, in evaluation order.
ENV_FLAGS = ["--action_env=", "--test_env=", "--repo_env="]
CLIENT_FLAG = "--client_env="


def _flag_value(arg: Column, prefix: str) -> Column:
    """(key, value) behind the last occurrence of ``prefix``; value null when there is no equals sign."""
    rest = F.substring_index(arg, prefix, -1)
    key = F.substring_index(rest, "=", 1)
    value = F.when(F.contains(rest, F.lit("=")), rest.substr(F.length(key) + 2, F.length(rest)))
    return F.when(F.contains(arg, F.lit(prefix)), F.struct(key.alias("key"), value.alias("value")))


def build_env(command_lines: DataFrame) -> DataFrame:
    """Environment entries per build: output flags, last one wins; bare keys take the client's value so far."""
    args = command_lines.select("invocation_id", SEQ, F.posexplode("args").alias("pos", "arg"))
    args = args.filter(F.contains("arg", F.lit("_env=")))
    flags = args.select(
        "invocation_id",
        SEQ,
        "pos",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("flag"), _flag_value(F.col("arg"), p).alias("kv"))
                    for i, p in enumerate([CLIENT_FLAG, *ENV_FLAGS])
                ]
            )
        ),
    ).filter(F.col("kv").isNotNull())
    flags = flags.select("invocation_id", SEQ, "pos", "flag", "kv.key", "kv.value")
    position = F.struct(SEQ, "pos", "flag")
    last = (
        flags.filter(F.col("flag") > 0)
        .groupBy("invocation_id", "key")
        .agg(F.max_by(F.struct("value", F.col(SEQ).alias("seq")), position).alias("last"))
    )
    client = flags.filter((F.col("flag") == 0) & F.col("value").isNotNull()).select(
        F.col("invocation_id").alias("c_inv"),
        F.col("key").alias("c_key"),
        F.struct(SEQ, "pos").alias("c_at"),
        F.col("value").alias("c_value"),
    )
    # an event's client values are all known before its own output flags are read
    bare = last.filter(F.col("last.value").isNull()).join(
        client,
        (F.col("invocation_id") == F.col("c_inv"))
        & (F.col("key") == F.col("c_key"))
        & (F.col(f"c_at.{SEQ}") <= F.col("last.seq")),
        "left",
    )
    bare = bare.groupBy("invocation_id", "key").agg(F.coalesce(F.max_by("c_value", "c_at"), F.lit("")).alias("value"))
    given = last.filter(F.col("last.value").isNotNull()).select("invocation_id", "key", F.col("last.value").alias("value"))
    return given.unionByName(bare)


def env_maps(env: DataFrame) -> DataFrame:
    """One map per build; keys are already unique."""
    return env.groupBy("invocation_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("env_vars")
    )


def union_sources(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Summaries still in memory win over the stored ones; the rest comes from the store."""
    missing = stored.join(live.select("invocation_id"), "invocation_id", "left_anti")
    return live.unionByName(missing, allowMissingColumns=True)


def client_versions(events: DataFrame) -> DataFrame:
    """Builds and outcomes per tool version; ``header``, ``user_agent`` and ``status`` columns."""
    v = X.client_version(F.col("header"), F.col("user_agent"))
    return (
        events.withColumn("v", v)
        .groupBy(F.col("v.major").alias("major"), F.col("v.minor").alias("minor"), F.col("v.patch").alias("patch"))
        .agg(
            F.count(F.lit(1)).alias("builds"),
            _count(F.col("status") == "success").alias("successful"),
            _count(F.col("status") == "failure").alias("failed"),
        )
    )
