"""Worker messages: one stream of four kinds, split into typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.operators.workers import state_name

# Body of each kind of worker message.
BODIES = {
    "registration": "worker_type STRING, labels ARRAY<STRING>, max_concurrent INT",
    "heartbeat": "timestamp_ms BIGINT, state INT, active_executions ARRAY<STRING>",
    "progress": "execution_id STRING, percent_complete DOUBLE, stage STRING",
    "result": "execution_id STRING, exit_code INT, execution_duration_ms BIGINT, completed_at_ms BIGINT",
}


def read_worker_messages(messages: DataFrame) -> dict[str, DataFrame]:
    """``messages``: worker_id, kind, body (JSON), batch or stream -> one typed table per kind."""
    rest = [c for c in messages.columns if c not in ("kind", "body")]
    out = {}
    for kind, schema in BODIES.items():
        of_kind = messages.filter(F.col("kind") == kind)
        out[kind] = of_kind.select(*rest, F.from_json("body", schema).alias("b")).select(*rest, "b.*")
    out["heartbeat"] = out["heartbeat"].withColumn("state", state_name(F.col("state")))
    return out
