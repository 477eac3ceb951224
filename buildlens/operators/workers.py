"""Worker fleet and connection health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.plans.ordered import SLICE, carry, cut, following, latest_rows, previous

ORDER = ["ts", "seq"]


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def state_name(code: Column) -> Column:
    """0 idle, 1 busy, anything else unhealthy."""
    return F.when(code == 0, "idle").when(code == 1, "busy").otherwise("unhealthy")


def latest_worker_state(log: DataFrame) -> DataFrame:
    return log.groupBy("worker_id").agg(
        state_name(F.max_by("state_code", F.struct(*ORDER))).alias("state"), F.max("ts").alias("heartbeat")
    )


def worker_stats(log: DataFrame) -> DataFrame:
    """Workers per current state; queue depth is how far busy exceeds idle."""
    states = latest_worker_state(log)
    counts = states.agg(
        *[_count(F.col("state") == s).alias(s) for s in ("idle", "busy", "unhealthy")], F.count(F.lit(1)).alias("total")
    )
    return counts.withColumn("queue_depth", F.greatest(F.col("busy") - F.col("idle"), F.lit(0)))


def pool_stats(log: DataFrame, pending: DataFrame) -> DataFrame:
    """Available, busy and total workers with the number of pending actions."""
    tagged = latest_worker_state(log).select("state").unionByName(pending.select(F.lit("pending").alias("state")))
    return tagged.agg(
        _count(F.col("state") == "idle").alias("available_workers"),
        _count(F.col("state") == "busy").alias("busy_workers"),
        _count(F.col("state") == "pending").alias("pending_actions"),
        _count(F.col("state").isin("idle", "busy")).alias("total_workers"),
    )


def workers_by_type(workers: DataFrame) -> DataFrame:
    return workers.groupBy("worker_type").agg(F.count(F.lit(1)).alias("workers"))


def oldest_idle_worker(log: DataFrame) -> DataFrame:
    idle = latest_worker_state(log).filter(F.col("state") == "idle")
    return idle.agg(F.min_by("worker_id", F.struct("heartbeat", "worker_id")).alias("worker_id"))


def label_coverage(assigned: DataFrame) -> DataFrame:
    """Required labels the assigned worker does not offer."""
    return assigned.withColumn("uncovered", F.array_except("required", "offered"))


ANY = "*"


def worker_match(requests: DataFrame, workers: DataFrame) -> DataFrame:
    """The idle worker with the oldest heartbeat that fits each request: same type when one is asked for, and all
    required labels.

    Containment is no equality, so both sides are first reduced to their distinct signatures (type and label set,
    and for workers only the best one), which are few whatever the number of rows. For no or one required label the
    best worker of each type and label is a grouped minimum. Signatures with more labels meet the workers' by the type
    and by that label which the fewest of them offer; containment is checked on those pairs alone.
    """
    want = requests.withColumn("required", F.array_sort(F.array_distinct("required")))
    signatures = want.select("worker_type", "required").distinct()
    classes = (
        workers.filter(F.col("state") == "idle")
        .withColumn("offered", F.array_sort(F.array_distinct("offered")))
        .groupBy(F.col("worker_type").alias("offered_type"), "offered")
        .agg(F.min(F.struct("heartbeat", "worker_id")).alias("best"))
    )
    # a null type stands for requests that take any
    types = F.array_distinct(F.array("offered_type", F.lit(None)))
    by_label = classes.withColumn("_type", F.explode(types)).select(
        "_type", "offered", "best", F.explode(F.array_append("offered", F.lit(ANY))).alias("_probe")
    )
    by_probe = by_label.groupBy("_type", "_probe").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))
    meets = F.col("worker_type").eqNullSafe(F.col("_type")) & (F.col("probe") == F.col("_probe"))
    few = signatures.filter(F.size("required") <= 1).withColumn("probe", F.coalesce(F.try_element_at("required", F.lit(1)), F.lit(ANY)))
    many = signatures.filter(F.size("required") > 1)
    offers = many.withColumn("probe", F.explode("required")).join(by_probe, meets, "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "probe"))["probe"].alias("probe")
    pairs = offers.groupBy("worker_type", "required").agg(rarest).join(by_label, meets)
    fits = F.size(F.array_except("required", "offered")) == 0
    best = pairs.filter(fits).groupBy("worker_type", "required").agg(F.min("best").alias("best"))
    best = best.unionByName(few.join(by_probe, meets).select("worker_type", "required", "best"))
    found = best.select(
        F.col("worker_type").alias("_type"), F.col("required").alias("_required"), F.col("best.worker_id").alias("worker_id")
    )
    cond = want["worker_type"].eqNullSafe(F.col("_type")) & (want["required"] == F.col("_required"))
    return want.join(found, cond, "left").select("request_id", "worker_id")


def service_counters(executions: DataFrame, lookups: DataFrame, states: DataFrame, connections: DataFrame) -> DataFrame:
    """Service counters as (metric, label, value): executions, cache, workers, and per-worker counts."""

    def total(df: DataFrame, **metrics: Column) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit("").alias("label"), F.col(n).alias("value")) for n in metrics])
        return df.agg(*[c.alias(n) for n, c in metrics.items()]).select(F.inline(entries))

    def per_worker(df: DataFrame, metric: str) -> DataFrame:
        counts = df.groupBy("worker_id").agg(F.count(F.lit(1)).alias("value"))
        return counts.select(F.lit(metric).alias("metric"), F.col("worker_id").cast("string").alias("label"), "value")

    hit = F.col("outcome") == "hit"
    reconnects = connections.groupBy("worker_id").agg(_count(F.col("event") == "connected").alias("n"))
    reconnects = reconnects.select(
        F.lit("worker_reconnections").alias("metric"),
        F.col("worker_id").cast("string").alias("label"),
        F.greatest(F.col("n") - 1, F.lit(0)).alias("value"),
    )
    return (
        total(executions, executions_total=F.count(F.lit(1)), executions_active=_count(F.col("exit_code").isNull()))
        .unionByName(total(lookups, cache_hits=_count(hit), cache_misses=_count(~hit)))
        .unionByName(
            total(
                latest_worker_state(states),
                workers_connected=F.count(F.lit(1)),
                workers_available=_count(F.col("state") == "idle"),
            )
        )
        .unionByName(per_worker(executions, "worker_executions"))
        .unionByName(reconnects)
    )


def connection_metrics(log: DataFrame, compat: bool = False, **options) -> DataFrame:
    """Connects, reconnects, disconnects, failed checks and the mean length of the last 100 connections.

    A connection ends at the first disconnect after a connect. By default every connect after the first is a
    reconnect; ``compat`` counts one only when no disconnect was recorded in between.
    """
    counts = log.groupBy("worker_id").agg(
        _count(F.col("event") == "connected").alias("connects"),
        _count(F.col("event") == "disconnected").alias("disconnects"),
        _count(F.col("event") == "health_check_failed").alias("failed_checks"),
    )
    ends = log.filter(F.col("event").isin("connected", "disconnected")).select("worker_id", "event", *ORDER)
    ends = previous(ends, ["worker_id"], ORDER, {"prev_event": "event", "prev_ts": "ts"}, **options)
    open_before = F.col("prev_event") == "connected"
    closed = ends.filter((F.col("event") == "disconnected") & open_before).withColumn(
        "length_us", F.unix_micros("ts") - F.unix_micros("prev_ts")
    )
    mean = latest_rows(closed, ["worker_id"], ORDER, 100).groupBy("worker_id").agg(F.avg("length_us").alias("mean_length_us"))
    out = counts.join(mean, "worker_id", "left")
    if compat:
        again = ends.filter((F.col("event") == "connected") & open_before)
        again = again.groupBy("worker_id").agg(F.count(F.lit(1)).alias("reconnects"))
        out = out.join(again, "worker_id", "left").withColumn("reconnects", F.coalesce("reconnects", F.lit(0)))
    else:
        out = out.withColumn("reconnects", F.greatest(F.col("connects") - 1, F.lit(0)))
    return out.withColumn("mean_length_us", F.coalesce("mean_length_us", F.lit(0.0)))


def last_round_trips(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` successful checks of each worker, as far as they follow its latest connect.

    What follows the latest connect is the newest part of a worker's checks, so the newest ``n`` are taken first:
    Spark keeps no more than that per worker and task before it shuffles. The latest connect is a combined maximum.
    """
    at = F.struct(*ORDER)
    reset = log.groupBy("worker_id").agg(F.max(F.when(F.col("event") == "connected", at)).alias("reset"))
    ok = latest_rows(log.filter(F.col("event") == "health_check_passed"), ["worker_id"], ORDER, n)
    return ok.join(reset, "worker_id").filter(F.col("reset").isNull() | (at > F.col("reset"))).drop("reset")


def rtt_stats(log: DataFrame, n: int = 100) -> DataFrame:
    """Mean, smallest and largest of the last ``n`` round trips since the last reconnect."""
    last = last_round_trips(log, n)
    return last.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("round_trips"),
        F.avg("rtt_us").alias("mean_us"),
        F.min("rtt_us").alias("min_us"),
        F.max("rtt_us").alias("max_us"),
    )


def latency_degradation(log: DataFrame) -> DataFrame:
    """Is a worker's network degraded now: its last check failed, or its last ten round trips average more than
    twice the ten before them."""
    relevant = F.col("event").isin("health_check_passed", "health_check_failed", "connected")
    failing = log.filter(relevant).groupBy("worker_id").agg(
        (F.max_by("event", F.struct(*ORDER)) == "health_check_failed").alias("failing")
    )
    last = last_round_trips(log, 20)
    recent = F.col("recency") <= 10
    means = last.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("round_trips"),
        F.avg(F.when(recent, F.col("rtt_us"))).alias("recent_us"),
        F.avg(F.when(~recent, F.col("rtt_us"))).alias("older_us"),
    )
    out = failing.join(means, "worker_id", "left")
    slower = (F.col("round_trips") >= 10) & (F.col("recent_us") > 2 * F.col("older_us"))
    return out.select("worker_id", "failing", (F.col("failing") | F.coalesce(slower, F.lit(False))).alias("degraded"))


def failure_streaks(log: DataFrame, **options) -> DataFrame:
    """Runs of consecutive successes and failures per worker."""
    checks = log.filter(F.col("event").startswith("health_check_")).select("worker_id", "event", *ORDER)
    seen = previous(cut(checks, ["worker_id"], ORDER, **options), ["worker_id"], ORDER, {"prev_event": "event"})
    first = F.col("prev_event").isNull() | (F.col("prev_event") != F.col("event"))
    began = F.when(first, F.struct(*ORDER))
    runs = carry(seen, ["worker_id"], ORDER, last={"began": began}, include_current=True)
    return runs.groupBy("worker_id", "began").agg(
        (F.first("event") == "health_check_failed").alias("failed"),
        F.count(F.lit(1)).alias("length"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def health_alerts(log: DataFrame, failures: int = 3, **options) -> DataFrame:
    """Failed checks at which the failure counter stands at or above the threshold.

    The counter grows with each failure and returns to zero only at a success that follows another one. It is the
    number of failures so far less their number at the last such success: two running quantities, no fold.
    """
    checks = log.filter(F.col("event").startswith("health_check_")).select("worker_id", "event", *ORDER)
    failed = F.col("event") == "health_check_failed"
    seen = previous(cut(checks, ["worker_id"], ORDER, **options), ["worker_id"], ORDER, {"prev_event": "event"})
    seen = carry(seen, ["worker_id"], ORDER, total={"failed_before": failed.cast("bigint")})
    reset = ~failed & (F.col("prev_event") == "health_check_passed")
    seen = carry(seen, ["worker_id"], ORDER, last={"failed_at_reset": F.when(reset, F.col("failed_before"))})
    counter = F.col("failed_before") + 1 - F.coalesce("failed_at_reset", F.lit(0))
    return seen.filter(failed).withColumn("failures", counter).filter(F.col("failures") >= failures).select(
        "worker_id", "ts", "seq", "failures"
    )


def state_sojourn(log: DataFrame, key: str = "worker_id", **options) -> DataFrame:
    """State changes with repeats dropped, the time spent in each state, and the position of the change."""
    seen = previous(cut(log.select(key, "state", *ORDER), [key], ORDER, **options), [key], ORDER, {"prev_state": "state"})
    changes = seen.filter(F.col("prev_state").isNull() | (F.col("prev_state") != F.col("state")))
    changes = carry(changes, [key], ORDER, total={"change": F.lit(1).cast("bigint")}, include_current=True)
    out = following(changes, [key], ORDER, {"next_ts": "ts"}).drop(SLICE)
    return out.withColumn("sojourn_us", F.unix_micros("next_ts") - F.unix_micros("ts")).drop("next_ts")


def execution_progress(log: DataFrame) -> DataFrame:
    """Latest progress per execution."""
    return log.groupBy("execution_id").agg(
        F.max_by("percent_complete", F.struct(*ORDER)).alias("percent_complete"), F.count(F.lit(1)).alias("updates")
    )


def ack_progress(events: DataFrame, **options) -> DataFrame:
    """Highest acknowledged sequence number per stream, with missing and repeated numbers."""
    distinct = events.groupBy("stream_id", "sequence_number").agg(F.count(F.lit(1)).alias("copies"))
    seen = previous(distinct, ["stream_id"], ["sequence_number"], {"before": "sequence_number"}, **options)
    gap = F.col("sequence_number") - F.col("before") - 1
    return seen.groupBy("stream_id").agg(
        F.max("sequence_number").alias("acknowledged"),
        _count(gap > 0).alias("gaps"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("missing"),
        F.sum(F.col("copies") - 1).alias("resent"),
    )
