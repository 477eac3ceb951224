"""Event logs: reading, filtering and flattening build events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens import schemas as S
from buildlens.functions import exprs as X
from buildlens.session import written

_BAD = "_malformed"


def read_event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON event per line below ``path/<invocation>/``: (events, lines that are no JSON object).

    Blank lines are skipped. The invocation is the directory name. ``line_order`` is the place in the file: the
    start of the file split and the row within it, so long files stay splittable.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.trim("value").alias("line"),
            F.regexp_extract("_metadata.file_path", "([^/=]+)/[^/]+$", 1).alias("invocation_id"),
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("line_order"),
        )
        .filter(F.col("line") != "")
    )
    parsed = lines.withColumn("e", _parse(F.col("line")))
    bad = F.col(f"e.{_BAD}").isNotNull() | ~F.startswith("line", F.lit("{"))
    events = parsed.filter(~bad).select("invocation_id", "line_order", "e.*").drop(_BAD)
    return events, parsed.filter(bad).select("invocation_id", "line")


def _parse(line: Column) -> Column:
    return F.from_json(line, f"{S.RAW_EVENT}, {_BAD} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})


def decode_filter(wrapped: DataFrame) -> DataFrame:
    """Keep wrapped build events: the type URL names one, or is empty."""
    url = F.coalesce("type_url", F.lit(""))
    # Endings of the type URL of a build event.
    return wrapped.filter(
        url.endswith("/build_event_stream.BuildEvent") | url.endswith("/BuildEvent") | (url == "")
    )


# Key of an event id object -> kind in the id text.
ID_KINDS = {
    "unknown": "Unknown",
    "progress": "Progress",
    "started": "BuildStarted",
    "build_finished": "BuildFinished",
    "action_completed": "ActionCompleted",
    "target_completed": "TargetCompleted",
    "test_result": "TestResult",
    "test_summary": "TestSummary",
    "pattern": "Pattern",
    "pattern_skipped": "PatternSkipped",
    "target_configured": "TargetConfigured",
    "configuration": "Configuration",
    "named_set": "NamedSetOfFiles",
    "workspace_status": "WorkspaceStatus",
    "options_parsed": "OptionsParsed",
    "build_metadata": "BuildMetadata",
    "unstructured_command_line": "UnstructuredCommandLine",
    "structured_command_line": "StructuredCommandLine",
    "build_tool_logs": "BuildToolLogs",
    "build_metrics": "BuildMetrics",
    "fetch": "Fetch",
    "target_summary": "TargetSummary",
    "convenience_symlinks_identified": "ConvenienceSymlinksIdentified",
    "exec_request": "ExecRequest",
    "test_progress": "TestProgress",
    "skyvalue_uploaded": "SkyValueUploaded",
    "configured_label": "ConfiguredLabel",
    "unconfigured_label": "UnconfiguredLabel",
}
# Ids whose text carries a label, and ids whose text carries patterns.
LABELLED_IDS = ["action_completed", "target_completed", "test_result", "test_summary", "target_configured"]
PATTERN_IDS = ["pattern", "pattern_skipped"]
# Prefixes of id texts from which a target label is read.
LABEL_PREFIXES = ["TargetCompleted:", "TargetConfigured:", "TestResult:", "TestSummary:"]


def id_text(key: Column, body: Column) -> Column:
    """``Kind``, ``Kind:label`` or ``Kind:pattern,pattern`` of an id given as its key and JSON body."""
    kind = F.coalesce(X.lookup(key, ID_KINDS), F.lit("Unknown"))
    label = F.coalesce(F.get_json_object(body, "$.label"), F.lit(""))
    patterns = F.array_join(F.coalesce(F.from_json(body, "array<string>"), F.array().cast("array<string>")), ",")
    return (
        F.when(key.isin(LABELLED_IDS), F.concat(kind, F.lit(":"), label))
        .when(key.isin(PATTERN_IDS), F.concat(kind, F.lit(":"), patterns))
        .otherwise(kind)
    )


def _after(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substr(text, F.lit(len(prefix) + 1)))


def label_of(id_: Column) -> Column:
    return F.coalesce(*[_after(id_, p) for p in LABEL_PREFIXES])


def normalize_event(raw: DataFrame, order: str = "sequence_number") -> DataFrame:
    """Raw events -> one flat table with the fields of all payload kinds, null where a kind has none.

    Payload objects are parsed once, with the union of their schemas; the kind is the one key of the object and
    needs no parsing. Logs keep the time of test results and summaries in the envelope only, so an event without a time
    in its payload takes the envelope's. ``failure_detail`` and ``spawn_cache_hit`` are fields that the log's writer has
    to add; without them they are null. Variant and parsed payload are columns of generators: those are computed once a row,
    where plain columns would be put into a later filter again for each time that it names them.
    """
    if "timestamp" not in raw.columns:
        raw = raw.withColumn("timestamp", F.lit(None).cast("string"))
    variant = F.regexp_extract("payload", r'^\s*\{\s*"([A-Za-z]+)"', 1)
    e = raw.select("*", F.explode(F.array(F.nullif(variant, F.lit("")))).alias("variant"))
    e = e.select("*", F.explode(F.array(F.from_json("payload", S.PAYLOAD))).alias("p"))
    kind = F.coalesce(X.lookup(F.col("variant"), S.KIND_OF_PAYLOAD), F.col("variant"))
    time = F.coalesce(
        "p.Started.start_time",
        "p.ActionExecuted.start_time",
        "p.Finished.finish_time",
        "p.TestResult.test_attempt_start",
        "p.TestSummary.first_start_time",
        "timestamp",
    )
    test_start = F.coalesce("p.TestResult.test_attempt_start", F.when(F.col("variant") == "TestResult", F.col("timestamp")))
    start, end = "p.ActionExecuted.start_time", "p.ActionExecuted.end_time"
    action_label = F.coalesce(_after(F.col("id"), "ActionCompleted:"), "p.ActionExecuted.label")
    return e.select(
        "invocation_id",
        F.col(order).alias("sequence_number"),
        F.coalesce("last_message", F.lit(False)).alias("last_message"),
        "id",
        "children",
        kind.alias("kind"),
        F.coalesce(label_of(F.col("id")), action_label).alias("label"),
        time.alias("timestamp"),
        X.instant(time).alias("event_ts"),
        F.coalesce("p.ActionExecuted.success", "p.Completed.success").alias("success"),
        F.coalesce("p.ActionExecuted.exit_code", "p.Finished.exit_code").alias("exit_code"),
        F.col("p.ActionExecuted.type").alias("action_type"),
        F.col("p.ActionExecuted.spawn_cache_hit").alias("spawn_cache_hit"),
        F.coalesce(start, "p.Started.start_time").alias("start_time"),
        F.coalesce(end, "p.Finished.finish_time").alias("end_time"),
        X.instant(F.col(start)).alias("start_ts"),
        X.instant(F.col(end)).alias("end_ts"),
        F.col("p.Started.command").alias("command"),
        F.col("p.Started.workspace_directory").alias("workspace"),
        F.col("p.Started.build_tool_version").alias("build_tool_version"),
        F.col("p.Finished.overall_success").alias("overall_success"),
        F.col("p.Completed.tag").alias("tags"),
        F.col("p.Configured.target_kind").alias("target_kind"),
        F.col("p.TestResult.status").alias("test_status"),
        F.col("p.TestResult.cached_locally").alias("cached_locally"),
        F.col("p.TestResult.cached_remotely").alias("cached_remotely"),
        X.instant(test_start).alias("test_start_ts"),
        F.col("p.TestResult.test_attempt_duration_ms").alias("test_duration_ms"),
        F.col("p.TestSummary.overall_status").alias("overall_status"),
        F.col("p.TestSummary.total_run_count").alias("total_run_count"),
        F.col("p.TestSummary.total_num_cached").alias("total_num_cached"),
        F.col("p.BuildMetrics.remote_cache_hits").alias("remote_cache_hits"),
        F.col("p.BuildMetrics.actions_executed").alias("actions_executed"),
        F.col("p.UnstructuredCommandLine.args").alias("args"),
        F.coalesce("p.Finished.failure_detail", "p.Completed.failure_detail").alias("failure_detail"),
        F.col("p.Started.uuid").alias("uuid"),
        F.col("p.Started.working_directory").alias("working_directory"),
        F.col("p.Progress.stdout").alias("stdout"),
        F.col("p.Progress.stderr").alias("stderr"),
        F.col("p.Aborted.reason").alias("abort_reason"),
        F.col("p.Aborted.description").alias("abort_description"),
        F.col("p.WorkspaceInfo.local_exec_root").alias("local_exec_root"),
        F.col("p.BuildMetadata.metadata").alias("metadata"),
        F.col("p.Configuration.mnemonic").alias("mnemonic"),
        F.col("p.Configuration.platform_name").alias("platform_name"),
        F.col("p.Configuration.cpu").alias("cpu"),
        F.col("p.Configured.actual").alias("actual"),
        F.col("p.OptionsParsed.cmd_line").alias("cmd_line"),
        F.col("p.OptionsParsed.startup_options").alias("startup_options"),
        F.col("p.WorkspaceStatus.item").alias("workspace_status"),
        F.col("p.StructuredCommandLine.type_url").alias("command_line_type"),
    )


# The columns that a build summary with targets and errors reads.
SUMMARY_FIELDS = [
    "invocation_id", "sequence_number", "kind", "label", "success", "command", "workspace", "start_time", "end_time", "overall_success",
    "exit_code", "cached_locally", "cached_remotely", "total_num_cached", "remote_cache_hits", "failure_detail",
]


def parsed_once(raw: DataFrame, fields: list[str], order: str = "sequence_number") -> DataFrame:
    """``normalize_event`` for work that reads its events several times, as summaries do: payloads are made and parsed in one
    pass, and the given fields kept as Parquet in the shared folder, where later passes read only the columns and kinds they need."""
    return written(normalize_event(raw, order).select(*fields), "events")


def event_edges(raw: DataFrame) -> DataFrame:
    """One row per announced child; an event without children keeps one row with nulls."""
    child = raw.select("invocation_id", F.col("id").alias("parent_id"), F.explode_outer("children").alias("child"))
    key = F.try_element_at(F.map_keys("child"), F.lit(1))
    body = F.try_element_at(F.map_values("child"), F.lit(1))
    text = F.when(F.col("child").isNotNull(), id_text(key, body))
    return child.select("invocation_id", "parent_id", text.alias("child_id"), label_of(text).alias("child_label"))
