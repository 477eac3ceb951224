"""Native record shapes and the small code tables, as fixed values."""

from __future__ import annotations

# Test status codes of the build-event wire format.
TEST_STATUS = {
    0: "NO_STATUS",
    1: "PASSED",
    2: "FLAKY",
    3: "TIMEOUT",
    4: "FAILED",
    5: "INCOMPLETE",
    6: "REMOTE_FAILURE",
    7: "FAILED_TO_BUILD",
    8: "TOOL_HALTED_BEFORE_TESTING",
}

# The statuses that count as a failed test run.
FAILED_TEST_STATUSES = [
    "TIMEOUT",
    "FAILED",
    "INCOMPLETE",
    "REMOTE_FAILURE",
    "FAILED_TO_BUILD",
    "TOOL_HALTED_BEFORE_TESTING",
]

# Payload variant -> event kind shown to users, where the two differ.
KIND_OF_PAYLOAD = {
    "Started": "BuildStarted",
    "Expanded": "PatternExpanded",
    "Completed": "TargetComplete",
    "Finished": "BuildFinished",
    "Configured": "TargetConfigured",
    "SkyvalueUploaded": "SkyValueUploaded",
}

# Internal execution stage -> public stage code and name.
PUBLIC_STAGE = {
    "Unknown": (0, "UNKNOWN"),
    "CacheCheck": (1, "CACHE_CHECK"),
    "Queued": (2, "QUEUED"),
    "Assigned": (3, "EXECUTING"),
    "Downloading": (3, "EXECUTING"),
    "Executing": (3, "EXECUTING"),
    "Uploading": (3, "EXECUTING"),
    "Completed": (4, "COMPLETED"),
    "Failed": (4, "COMPLETED"),
}

# Stages that may follow each stage.
LEGAL_NEXT = {
    "Unknown": ["CacheCheck", "Failed"],
    "CacheCheck": ["Queued", "Completed", "Failed"],
    "Queued": ["Assigned", "Failed"],
    "Assigned": ["Downloading", "Completed", "Failed"],
    "Downloading": ["Executing", "Completed", "Failed"],
    "Executing": ["Uploading", "Completed", "Failed"],
    "Uploading": ["Completed", "Failed"],
}

# Gate limits per benchmark metric (metric, limit, unit, direction that passes).
GATE_LIMITS = [
    ("memory_mb", 20.0, "MB", "le"),
    ("cold_start_ms", 500.0, "ms", "le"),
    ("execution_p99_ms", 100.0, "ms", "le"),
    ("cache_p99_us", 1000.0, "us", "le"),
    ("churn_cleanup_rate", 95.0, "%", "ge"),
    ("streaming_delta_mb", 100.0, "MB", "le"),
]

# Version handlers as [from, to) ranges of (major, minor, patch).
VERSION_HANDLERS = [
    ("v7", (7, 0, 0), (8, 0, 0)),
    ("v8", (8, 0, 0), (9, 0, 0)),
    ("v9", (9, 0, 0), None),
]

# Schemas are kept as DDL text, which needs no running session to write down.
RAW_EVENT = (
    "sequence_number BIGINT, type_url STRING, last_message BOOLEAN, id STRING, kind STRING, timestamp STRING, "
    "children ARRAY<MAP<STRING, STRING>>, payload STRING"
)

# The union of payload fields the analytics use; every payload is an object with one of these keys.
PAYLOAD = (
    "Progress STRUCT<stdout STRING, stderr STRING>,"
    "Aborted STRUCT<reason STRING, description STRING>,"
    "Started STRUCT<uuid STRING, command STRING, workspace_directory STRING, working_directory STRING,"
    " build_tool_version STRING, start_time STRING>,"
    "ActionExecuted STRUCT<success BOOLEAN, type STRING, exit_code INT, label STRING, start_time STRING,"
    " end_time STRING, spawn_cache_hit BOOLEAN>,"
    "Completed STRUCT<success BOOLEAN, tag ARRAY<STRING>, failure_detail STRING>,"
    "TestSummary STRUCT<overall_status INT, total_run_count INT, total_num_cached INT, first_start_time STRING>,"
    "TestResult STRUCT<status INT, cached_locally BOOLEAN, cached_remotely BOOLEAN, test_attempt_start STRING,"
    " test_attempt_duration_ms BIGINT>,"
    "Finished STRUCT<overall_success BOOLEAN, exit_code INT, finish_time STRING, failure_detail STRING>,"
    "BuildMetrics STRUCT<remote_cache_hits BIGINT, actions_executed BIGINT>,"
    "WorkspaceInfo STRUCT<local_exec_root STRING>,"
    "BuildMetadata STRUCT<metadata MAP<STRING, STRING>>,"
    "Configuration STRUCT<mnemonic STRING, platform_name STRING, cpu STRING>,"
    "Configured STRUCT<target_kind STRING, actual STRING>,"
    "UnstructuredCommandLine STRUCT<args ARRAY<STRING>>,"
    "OptionsParsed STRUCT<cmd_line ARRAY<STRING>, startup_options ARRAY<STRING>>,"
    "WorkspaceStatus STRUCT<item ARRAY<STRUCT<key STRING, value STRING>>>,"
    "StructuredCommandLine STRUCT<type_url STRING>"
)

TARGET_HISTORY = (
    "label STRING, target_kind STRING, invocation_id STRING, status STRING, tags ARRAY<STRING>,"
    "build_start_time STRING, build_end_time STRING, build_duration_ms BIGINT, action_duration_ms BIGINT,"
    "action_count BIGINT, cached_actions BIGINT, failed_actions BIGINT, env_vars MAP<STRING, STRING>"
)

TEST_HISTORY = (
    "label STRING, invocation_id STRING, status STRING, cached_locally BOOLEAN, cached_remotely BOOLEAN,"
    "start_time STRING, end_time STRING, duration_ms BIGINT"
)

BUILD_SUMMARY = (
    "invocation_id STRING, command STRING, workspace STRING, start_time STRING, end_time STRING,"
    "duration_ms BIGINT, status STRING, total_actions BIGINT, cached_actions BIGINT, local_actions BIGINT,"
    "failed_actions BIGINT, remote_cache_hits BIGINT, targets ARRAY<STRING>, errors ARRAY<STRING>"
)
