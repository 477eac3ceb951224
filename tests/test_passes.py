"""Work is done once: no source computed again for each filter, aggregate or write that follows."""

import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as E
from buildlens.operators import benchmarks as M
from buildlens.operators import builds as B
from buildlens.operators import targets as T
from buildlens.plans import standins as D
from buildlens.sources import event_log as L
from buildlens.sources import history as H
from buildlens.streaming import builds as S
from buildlens.streaming import finalize as Z


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_made_and_cut_once(spark):
    rows = [(1, '{"l": "1.5%|1MiB / 2GB|3%|4kB / 5kB|0B / 2TB|6"}'), (2, '{"l": "oops|1"}'), (3, None), (4, '{"l": "1%|1|3%|4kB / 5kB|0B / 2TB|6"}'),
            (5, '{"l": "1%|x / y|3%|4kB / 5kB|0B / 2TB|6"}')]
    lines = spark.createDataFrame(rows, "seq bigint, j string").select("seq", F.get_json_object("j", "$.l").alias("line"))
    good, bad = M.sample_normalize(lines)
    assert sorted(r.seq for r in bad.collect()) == [2, 3, 4] and bad.columns == ["seq", "line"]
    assert {r.seq: r.memory_usage_mb for r in good.collect()} == {1: 1.0, 5: 0.0}
    log = spark.range(3).select(F.col("id").alias("seq"), F.get_json_object(F.concat(F.lit('{"l": "'), "id", F.lit('"}')), "$.l").alias("line"))
    assert plan(M.sample_normalize(log)[1]).count("get_json_object") <= 2


def test_payloads_are_made_and_parsed_once(spark, sf_dir):
    raw = L.decode_filter(D.raw_events(spark, sf_dir, completions=True))
    made = plan(raw).count("StructsToJsonEvaluator")
    told = plan(B.build_errors(L.normalize_event(raw)))
    assert told.count("StructsToJsonEvaluator") <= made and told.count("regexp_extract") <= made and told.count("from_json") <= made
    summary = E.queries()["build_summary_errors"](spark, sf_dir)
    assert "json" not in plan(summary).lower() and "json" not in plan(E.queries()["summary_from_log"](spark, sf_dir)).lower()
    kept = L.parsed_once(raw, L.SUMMARY_FIELDS)
    direct = B.build_summary(L.normalize_event(raw), errors=True)
    assert sorted(map(str, B.build_summary(kept, errors=True).collect())) == sorted(map(str, direct.collect()))


def test_histories_are_computed_once_and_compressed(spark, sf_dir, tmp_path, monkeypatch):
    given = []
    append = H.append_target_history
    monkeypatch.setattr(H, "append_target_history", lambda df, path: (given.append((plan(df), path)), append(df, path)))
    n = E.queries()["append_target_history"](spark, sf_dir).count()
    assert len(given) == 2 and not any("Aggregate" in p or "Join" in p for p, _ in given)
    parts = [f for f in os.listdir(given[0][1]) if f.startswith("part-")]
    assert parts and all(f.endswith(".json.gz") for f in parts)
    spark.createDataFrame([("other",)], "label string").coalesce(1).write.mode("append").json(given[0][1])  # a plain file beside them
    assert H.read_target_history(spark, given[0][1]).count() == n + 1


def test_summaries_are_computed_once(spark, sf_dir, monkeypatch):
    given = []
    write = H.write_summary
    monkeypatch.setattr(H, "write_summary", lambda df, path, version: (given.append(plan(df)), write(df, path, version)))
    E.queries()["compact_summaries"](spark, sf_dir).count()
    assert len(given) == 2 and not any("Aggregate" in p or "Join" in p for p in given)


def test_equal_arrays_are_reduced_before_their_items_are_taken_apart(spark):
    rows = spark.createDataFrame([("a", ["x", "y", "x"], 2), ("a", ["x", "y", "x"], 5), ("a", ["z", "y"], 1), ("a", None, 0), ("b", [], 1)], "k string, t array<string>, o int")
    out = T.distinct_ordered(rows, "k", "t", "o")
    assert [tuple(r) for r in out.collect()] == [("a", ["z", "y", "x"])]
    text = plan(out)
    assert "Aggregate" in text[text.index("Generate"):]


def test_first_marks_need_no_state_of_python(spark):
    table = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("invocation_id", "done_at", "done_ts"), r)) for r in rows])
    out = pa.Table.from_batches(Z._first_marks(iter([table((2, 9, 1), (1, 5, 3)), table((1, 4, 7), (2, 9, 0)), table((1, 4, 8))])))
    assert sorted(tuple(r.values()) for r in out.to_pylist()) == [(1, 4, 7), (2, 9, 0)]
    events = spark.readStream.format("rate").load().selectExpr(
        "value AS invocation_id", "'BuildFinished' AS kind", "true AS last_message", "'' AS label", "true AS success", "value AS sequence_number", "timestamp AS ts"
    )
    text = Z.finalize_build(events)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in text and "DeduplicateWithinWatermark" in text


def test_a_new_key_asks_for_no_timers():
    from types import SimpleNamespace

    calls = []
    state = lambda: SimpleNamespace(exists=lambda: False, put=calls.append, update=calls.append, clear=lambda: None)
    monitor = S.Silence(60_000)
    monitor.spans, monitor.told = state(), state()
    monitor.handle = SimpleNamespace(registerTimer=calls.append)  # listTimers and deleteTimer would raise
    rows = pd.DataFrame({"us": [200_000_000, 0, 30_000_000], "closing": [False, False, False]})
    assert list(monitor.handleInputRows((1,), iter([rows]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))) == []
    assert [(0, 30_000_000), (200_000_000, 200_000_000)] in calls and (None, False) in calls and 199_999 in calls and 90_001 in calls
