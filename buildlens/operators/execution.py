"""Execution logs: stages, queue classes, request merging, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens import schemas as S
from buildlens.functions import exprs as X
from buildlens.plans.ordered import MAX_SLICE_ROWS, carry, cut, following, latest_rows, previous
from buildlens.session import checkpointed

# A step is at most this long, and an operation is dead or stale after this long (seconds).
ALIVE_SECONDS, DEAD_SECONDS, STALE_SECONDS = 60, 300, 3600
MIB = 1024 * 1024


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def queue_class(inputs: DataFrame, fast_below: int = MIB, medium_below: int = 100 * MIB) -> DataFrame:
    """Class of each operation by the total size of its inputs."""
    total = inputs.groupBy("operation_id").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("input_bytes"))
    size = F.col("input_bytes")
    return total.withColumn(
        "queue", F.when(size < fast_below, "fast").when(size < medium_below, "medium").otherwise("slow")
    )


def stage_mix(log: DataFrame) -> DataFrame:
    """Log entries per public stage."""
    code = X.lookup(F.col("stage"), {k: v[0] for k, v in S.PUBLIC_STAGE.items()}, 0)
    name = X.lookup(F.col("stage"), {k: v[1] for k, v in S.PUBLIC_STAGE.items()}, "UNKNOWN")
    return log.groupBy(code.alias("stage_code"), name.alias("stage_name")).agg(F.count(F.lit(1)).alias("entries"))


def result_mix(executions: DataFrame) -> DataFrame:
    """Executions per outcome: status 0 or 1 from the exit code, 2 when there is no result."""
    status = F.when(F.col("exit_code").isNull(), 2).when(F.col("exit_code") == 0, 0).otherwise(1)
    return executions.groupBy(
        status.alias("status"), F.when(F.coalesce("cached", F.lit(False)), "cached").otherwise("executed").alias("origin")
    ).agg(F.count(F.lit(1)).alias("executions"))


def resolve_actions(requests: DataFrame, actions: DataFrame, commands: DataFrame) -> DataFrame:
    """Requests with their action and command, and why one could not be resolved.

    Requests are many and repeat the same digests, so actions meet their commands first.
    """
    known = actions.join(
        commands.withColumn("_command", F.lit(True)), "command_hash", "left"
    ).withColumn("_action", F.lit(True))
    legacy = F.size("output_paths") == 0
    out = requests.join(known, "action_hash", "left")
    state = (
        F.when(F.col("action_hash").isNull(), "missing digest")
        .when(F.col("_action").isNull(), "action not found")
        .when(F.col("command_hash").isNull(), "command missing")
        .when(F.col("_command").isNull(), "command not found")
        .otherwise("resolved")
    )
    ok = state == "resolved"
    return out.select(
        "request_id",
        "action_hash",
        state.alias("resolution"),
        F.when(ok, F.when(F.col("timeout_seconds") > 0, F.col("timeout_seconds")).otherwise(300)).alias("timeout_seconds"),
        F.when(ok, F.when(legacy, F.col("output_files")).otherwise(F.col("output_paths"))).alias("output_files"),
        F.when(ok, F.when(legacy, F.col("output_directories")).otherwise(F.array().cast("array<string>"))).alias(
            "output_directories"
        ),
    )


def result_join(operations: DataFrame, results: DataFrame) -> DataFrame:
    """Results to operations by the number in ``exec-N``; either side without a partner is listed."""
    number = F.regexp_extract("execution_id", "^exec-([0-9]+)$", 1).try_cast("bigint")
    r = results.withColumn("operation_number", number)
    # results without a number match nothing; as null keys they would all meet in one task
    numbered, rest = r.filter(number.isNotNull()), r.filter(number.isNull())
    out = operations.join(numbered, F.col("operation_id") == F.col("operation_number"), "full")
    out = out.unionByName(rest, allowMissingColumns=True)
    return out.select(
        "operation_id",
        "execution_id",
        F.when(F.col("operation_id").isNull(), "unmatched result")
        .when(F.col("execution_id").isNull(), "no result")
        .when(F.col("exit_code") == 0, "completed")
        .otherwise("failed")
        .alias("outcome"),
    )


def version_range_join(versions: DataFrame) -> DataFrame:
    """Handler whose range holds the version, else the default one, and the protocol level.

    ``versions`` has a ``version`` struct of major, minor and patch. The ranges are fixed and do not overlap, so they
    are cases of one expression.
    """
    v = F.col("version")

    def at(triple: tuple[int, int, int]) -> Column:
        return F.struct(*[F.lit(n).alias(part) for n, part in zip(triple, ("major", "minor", "patch"))])

    held = [F.when((v >= at(lo)) & ((v < at(hi)) if hi else F.lit(True)), handler) for handler, lo, hi in S.VERSION_HANDLERS]
    return versions.withColumns(
        {
            "handler": F.coalesce(*held, F.lit("default")),
            "protocol": F.when(F.col("version.major") == 7, "2.3").otherwise("2.4"),
        }
    )


def stage_durations(log: DataFrame, **options) -> DataFrame:
    """Time each operation spent in each stage entry; the last entry is open."""
    out = following(log, ["operation_id"], ["ts", "seq"], {"next_ts": "ts"}, **options)
    return out.withColumn("duration_us", F.unix_micros("next_ts") - F.unix_micros("ts")).drop("next_ts")


def operation_elapsed(log: DataFrame) -> DataFrame:
    return log.groupBy("operation_id").agg(
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("elapsed_us"), F.count(F.lit(1)).alias("entries")
    )


def legal(before: Column, after: Column) -> Column:
    """May ``after`` follow ``before``?"""
    pairs = [F.when(before == k, after.isin(v)) for k, v in S.LEGAL_NEXT.items()]
    return F.coalesce(*pairs, F.lit(False))


def transition_audit(log: DataFrame, **options) -> DataFrame:
    """Consecutive entries that the stage model does not allow. An operation starts in CacheCheck."""
    out = previous(log, ["operation_id"], ["ts", "seq"], {"from_stage": "stage"}, **options)
    out = out.withColumn("from_stage", F.coalesce("from_stage", F.lit("CacheCheck")))
    return out.filter(~legal(F.col("from_stage"), F.col("stage"))).select(
        "operation_id", "seq", "ts", "from_stage", F.col("stage").alias("to_stage")
    )


# An accepted step never returns to an earlier stage, so an operation accepts at most this many.
MAX_STEPS = 6


def transition_replay(log: DataFrame) -> DataFrame:
    """The steps an operation really took: an illegal entry is rejected and leaves the stage as it was.

    The steps are found one after another: each of at most six rounds picks, per operation, the first later entry that
    is legal from the current stage, with a combined minimum and no gathered rows.
    """
    entries = log.select("operation_id", F.struct("ts", "seq").alias("at"), "stage")
    now = entries.select("operation_id").distinct().withColumns(
        {"cur": F.lit("CacheCheck"), "cur_at": F.lit(None).cast("struct<ts:timestamp,seq:bigint>")}
    )
    taken = []
    for i in range(1, MAX_STEPS + 1):
        later = F.col("cur_at").isNull() | (F.col("at") > F.col("cur_at"))
        found = (
            entries.join(now, "operation_id")
            .filter(later & legal(F.col("cur"), F.col("stage")))
            .groupBy("operation_id")
            .agg(F.min(F.struct("at", "stage")).alias("hit"))
        )
        now = checkpointed(found.select("operation_id", F.col("hit.stage").alias("cur"), F.col("hit.at").alias("cur_at")))
        taken.append(now.select("operation_id", F.lit(i).alias("step"), "cur_at.ts", "cur_at.seq", F.col("cur").alias("stage")))
        if now.isEmpty():
            break
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def history_cap(log: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` entries of each operation."""
    return latest_rows(log, ["operation_id"], ["ts", "seq"], n)


def stuck_operations(log: DataFrame, now_us: int) -> DataFrame:
    """Operations not in a final stage that are silent, dead or stale at the given time."""
    now = F.lit(now_us)
    out = log.groupBy("operation_id").agg(
        F.max_by("stage", F.struct("ts", "seq")).alias("stage"),
        (now - F.unix_micros(F.max("ts"))).alias("silent_us"),
        (now - F.unix_micros(F.min("ts"))).alias("age_us"),
    )
    sec = 1_000_000
    flagged = out.filter(~F.col("stage").isin("Completed", "Failed")).withColumns(
        {
            "not_alive": F.col("silent_us") >= ALIVE_SECONDS * sec,
            "dead": F.col("silent_us") > DEAD_SECONDS * sec,
            "stale": F.col("age_us") > STALE_SECONDS * sec,
        }
    )
    return flagged.filter(F.col("not_alive") | F.col("dead") | F.col("stale"))


def merge_inflight(requests: DataFrame, max_rows: int = MAX_SLICE_ROWS) -> DataFrame:
    """Each request with the request that leads it: a digest already in flight is not queued again.

    Followers do not extend their leader, so who leads depends on who led before. A request that arrives when
    every earlier one of its digest is done leads for certain. From any leader the next one is the first request
    at or after its completion; these pointers are found for all requests in one ordered pass, and the leaders
    are what the certain ones reach along them. Doubling the pointers takes a number of rounds logarithmic in the
    longest chain, over joins on unique request ids, so a digest with a third of all requests spreads evenly.
    """
    keys = ["hash"]
    order = ["enqueued_us", "seq"]
    done = F.greatest(F.col("completed_us"), F.col("enqueued_us"))
    rows = cut(requests.select("hash", "seq", "enqueued_us", done.alias("completed_us")), keys, order, max_rows)
    rows = carry(rows, keys, order, peak={"busy_until": F.col("completed_us")})
    rows = rows.withColumn("certain", F.col("busy_until").isNull() | (F.col("busy_until") <= F.col("enqueued_us")))
    rows = checkpointed(rows.drop("busy_until"))
    # Completions look ahead for the first request at or after them; one that completes on arrival looks ahead
    # from its own place among the requests of that instant.
    at_once = (F.col("completed_us") == F.col("enqueued_us")).cast("int")
    marks = rows.select(
        "hash",
        F.inline(
            F.array(
                F.struct(F.col("enqueued_us").alias("at"), F.lit(1).alias("rank"), "seq", F.lit(0).alias("is_end"), "certain"),
                F.struct(F.col("completed_us").alias("at"), at_once.alias("rank"), "seq", F.lit(1).alias("is_end"), "certain"),
            )
        ),
    )
    ahead = F.when(F.col("is_end") == 0, F.struct(F.col("seq").alias("seq"), F.col("certain").alias("certain")))
    marks = carry(marks, keys, ["at", "rank", "seq", "is_end"], last={"nxt": ahead}, descending=True, max_rows=max_rows)
    # a pointer to a certain leader adds nothing
    jump = marks.filter((F.col("is_end") == 1) & ~F.col("nxt.certain")).select("seq", F.col("nxt.seq").alias("to"))
    jump = checkpointed(jump)
    leaders = rows.filter("certain").select("seq")
    while not jump.isEmpty():
        # leaders of one digest come one after another, so what is reached is new and reached once
        reached = jump.join(leaders, "seq", "left_semi").select(F.col("to").alias("seq"))
        leaders = checkpointed(leaders.unionByName(reached))
        second = jump.select(F.col("seq").alias("to"), F.col("to").alias("to2"))
        jump = checkpointed(jump.join(second, "to").select("seq", F.col("to2").alias("to")))
    led = rows.join(leaders.withColumn("leads", F.lit(True)), "seq", "left")
    me = F.when(F.col("leads"), F.col("seq"))
    out = carry(led, keys, order, last={"merged_into": me}, include_current=True)
    return out.select("seq", "hash", "enqueued_us", "merged_into", (F.col("seq") == F.col("merged_into")).alias("leader"))


def merge_ratio(merged: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return merged.groupBy("hash").agg(
        n.alias("requests"), _count(F.col("leader")).alias("leaders"), (1 - _count(F.col("leader")) / n).alias("merge_ratio")
    )


def queue_stats(items: DataFrame, at_us: int) -> DataFrame:
    """Queued items per class and items in flight at a point in time."""
    t = F.lit(at_us)
    entered = F.col("enqueued_us") <= t
    waiting = entered & (F.col("dequeued_us").isNull() | (t < F.col("dequeued_us")))
    flying = entered & (F.col("completed_us").isNull() | (t < F.col("completed_us")))
    return items.filter(entered).agg(
        *[_count(waiting & (F.col("queue") == q)).alias(f"{q}_queued") for q in ("fast", "medium", "slow")],
        _count(flying).alias("in_flight"),
    )


def active_executions(started: DataFrame, finished: DataFrame, workers: DataFrame, queues: DataFrame) -> DataFrame:
    """Started but unfinished executions beside the worker and queue counts, as one long metric table."""
    open_ = started.select("execution_id").distinct().join(finished.select("execution_id"), "execution_id", "left_anti")
    count = open_.agg(F.count(F.lit(1)).alias("active_executions"))

    def long(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in df.columns])
        return df.select(F.inline(pairs))

    return long(count).unionByName(long(workers)).unionByName(long(queues))
