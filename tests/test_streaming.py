"""Streams over several batches: resent events, late completions, silence, and batch equality."""

import pytest
from pyspark.sql import functions as F

from buildlens.operators import builds as B
from buildlens.plans import standins as D
from buildlens.sources.history import read_summary
from buildlens.operators import workers as W
from buildlens.streaming import builds as S
from buildlens.streaming import finalize as Z
from buildlens.streaming import sequences as Q


@pytest.fixture
def arrivals(spark, tmp_path):
    """Write rows as files in order, and read them back as a stream of one file per batch."""

    def make(batches, schema):
        src = str(tmp_path / "in")
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)

    return make


def drain(spark, stream, tmp_path):
    S.run_available(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), str(tmp_path / "cp"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


EVENT = "invocation_id bigint, kind string, last_message boolean, label string, success boolean, sequence_number bigint, t bigint"


def test_finalize_emits_once_and_reports_late_rows(spark, arrivals, tmp_path):
    stream = arrivals(
        [
            [(1, "TargetComplete", False, "//a", True, 1, 10), (2, "TargetComplete", False, "//x", True, 1, 11)],
            [(1, "BuildFinished", False, None, None, 3, 13), (1, "TestResult", False, "//b", False, 2, 12), (1, "Progress", True, None, None, 9, 14)],
            [(1, "TargetComplete", False, "//late", True, 4, 15), (3, "Progress", True, None, None, 1, 16)],
            [(3, "TestResult", False, "//after", True, 2, 17), (1, "BuildFinished", True, None, None, 5, 18)],
        ],
        EVENT,
    )
    out = drain(spark, Z.finalize_build(stream.withColumn("ts", F.timestamp_seconds("t"))), tmp_path)
    assert sorted((r.invocation_id, r.kind, r.label, r.success, r.late) for r in out.collect()) == [
        (1, "TargetComplete", "//a", True, False), (1, "TargetComplete", "//late", True, True), (1, "TestResult", "//b", False, False),
        (3, "TestResult", "//after", True, True),
    ]


def test_finalize_gives_each_row_once_where_builds_share_a_key(spark, arrivals, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(Z, "KEYS", 3)
    rng, batches = random.Random(5), []
    for at in range(4):
        kinds = [rng.choice(["TargetComplete", "TestResult", "TestResult", "Progress", "BuildFinished"]) for _ in range(120)]
        batches.append([(f"b{rng.randrange(40)}", k, k == "Progress" and rng.random() < 0.3, rng.choice([None, "//a", "//b"]), rng.choice([None, True, False]), rng.randrange(100), rng.randrange(9999)) for k in kinds])
    marks = {}
    for rows in batches:
        new = {}
        for b, k, last, *_, seq, _t in rows:
            if (k == "BuildFinished" or last) and b not in marks:
                new[b] = min(seq, new.get(b, seq))
        marks |= new
    said = [r for rows in batches for r in rows if r[1] in Z.REPORTED and r[0] in marks]
    want = [(b, k, label, ok, seq, seq > marks[b]) for b, k, _last, label, ok, seq, _t in said]
    stream = arrivals(batches, EVENT.replace("invocation_id bigint", "invocation_id string"))
    out = drain(spark, Z.finalize_build(stream.withColumn("ts", F.timestamp_seconds("t"))), tmp_path)
    assert want and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_finalize_keeps_the_hours_between_rows_and_marks(spark, arrivals, tmp_path):
    """Also where rows of several times share a pack, and across the bounds of its slices."""
    hour = 3600
    rows = [(1, "TestResult", False, f"{h}", True, 1, h * hour) for h in range(100)] + [(b, "BuildFinished", False, None, None, 2, h * hour) for b, h in ((1, 47), (2, 10))]
    out = drain(spark, Z.finalize_build(arrivals([rows], EVENT).withColumn("ts", F.timestamp_seconds("t")), hours=24), tmp_path)
    assert sorted(int(r.label) for r in out.collect()) == list(range(23, 72))


def test_finalize_keeps_rows_in_packs(spark, arrivals, tmp_path):
    batch = [(b, "TestResult", False, "//a", True, n, n + 1) for b in (1, 2) for n in range(300)] + [(1, "BuildFinished", False, None, None, 9, 9)]
    stream = Z.finalize_build(arrivals([batch], EVENT).withColumn("ts", F.timestamp_seconds("t")))
    q = S.run_available(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), str(tmp_path / "cp"))
    assert spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count() == 300
    kept = {o["operatorName"]: o["numRowsTotal"] for o in q.lastProgress["stateOperators"]}
    assert kept["symmetricHashJoin"] == 3, kept


def test_packs_are_bounded(monkeypatch):
    import pyarrow as pa

    n, hour = 2 * Z.PACK + 5, 3_600_000_000
    monkeypatch.setattr(Z, "HELD_BYTES", 1 << 16)
    rows = pa.table({"invocation_id": ["a", "b"] * n, "ts": pa.array([i * hour // 100 for i in range(2 * n)], pa.timestamp("us", "UTC")), "_key": pa.array([7, 3] * n, pa.int32())})
    out = pa.Table.from_batches(Z._packed(24)(iter(rows.to_batches(max_chunksize=1000)))).to_pylist()
    assert max(len(r["ts"]) for r in out) <= Z.PACK and all(len(r["ts"]) == len(r["invocation_id"]) for r in out)
    assert sorted(t for r in out for t in r["ts"]) == rows["ts"].to_pylist() and all(max(r["ts"]) == r["_newest"] for r in out)
    assert all({t.date() for t in r["ts"]} == {r["_newest"].date()} for r in out)
    assert {(r["_key"], i) for r in out for i in r["invocation_id"]} == {(7, "a"), (3, "b")}


def test_settings_hold_for_their_stream_only(spark, arrivals, tmp_path):
    key, seen = next(iter(Z.BY_ROWS)), []
    before = spark.conf.get(key)
    stream = arrivals([[(1, 2)], [(3, 4)]], "a bigint, b bigint")
    S.run_available(stream.writeStream.foreachBatch(lambda batch, _: seen.append(batch.sparkSession.conf.get(key))), str(tmp_path / "cp"), Z.BY_ROWS)
    assert seen == [Z.BY_ROWS[key]] * 2 and spark.conf.get(key) == before != Z.BY_ROWS[key]


def test_instants_need_no_cast(spark, sf_dir):
    fields = lambda **given: dict(D.stream_table(spark, sf_dir, "lineitem", **given).dtypes)
    assert fields() | {"l_shipdate": "timestamp"} == fields(instants=True)
    read = spark.read.schema(D.stream_table(spark, sf_dir, "lineitem", instants=True).schema).parquet(f"{sf_dir}/lineitem.parquet")
    days = lambda df: df.select("l_orderkey", F.unix_micros(F.col("l_shipdate").cast("timestamp"))).exceptAll
    plain = D.table(spark, sf_dir, "lineitem")
    assert days(read)(plain.select("l_orderkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")))).isEmpty()


def test_finalize_releases_state(spark, arrivals, tmp_path):
    """Builds a hundred hours apart: marks and rows of the earlier ones are gone."""
    batches = [[(k, "TargetComplete", False, "//a", True, 1, k * 360_000), (k, "BuildFinished", False, None, None, 2, k * 360_000 + 5)] for k in range(1, 7)]
    stream = Z.finalize_build(arrivals(batches, EVENT).withColumn("ts", F.timestamp_seconds("t")), hours=24)
    q = S.run_available(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), str(tmp_path / "cp"))
    assert spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count() == 6
    kept = {o["operatorName"]: o["numRowsTotal"] for o in q.lastProgress["stateOperators"]}
    assert kept["symmetricHashJoin"] <= 4, kept


def test_numbers_out_of_order_give_the_batch_answer(spark, arrivals, tmp_path):
    batches = [[(1, n) for n in (5, 6, 9)] + [(2, 3)], [(1, 7), (1, 5)], [(1, 8), (1, 1), (2, 1), (2, 1)], [(1, 12), (2, 2)]]
    schema = "stream_id bigint, sequence_number bigint"
    out = drain(spark, Q.ack_stream(arrivals(batches, schema)), tmp_path)
    last = {r.stream_id: r for r in out.orderBy("version").collect()}
    batch = W.ack_progress(spark.createDataFrame([r for b in batches for r in b], schema)).collect()
    assert {r.stream_id: (r.acknowledged, r.gaps, r.missing, r.resent) for r in batch} == {k: (r.acknowledged, r.gaps, r.missing, r.resent) for k, r in last.items()}
    assert {(r.stream_id, r.version): (r.contiguous, r.filled) for r in out.collect()} == {
        (1, 1): (6, 0), (1, 2): (7, 1), (1, 3): (1, 1), (1, 4): (1, 0), (2, 1): (3, 0), (2, 2): (1, 0), (2, 3): (3, 1),
    }


def test_a_silent_operation_is_reported_without_a_further_event(spark, arrivals, tmp_path):
    import time

    schema = "operation_id bigint, stage string, seq bigint, t bigint"
    stream = arrivals([[(1, "Queued", 0, 1), (2, "Executing", 0, 1), (1, "Completed", 1, 2)]], schema).withColumn("ts", F.timestamp_seconds("t"))
    q = Q.stuck_operation_stream(stream, 1).writeStream.format("memory").queryName("stuck").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and not spark.table("stuck").count():
            time.sleep(0.5)
        assert [(r.operation_id, r.stage, r.last_us) for r in spark.table("stuck").collect()] == [(2, "Executing", 1_000_000)]
    finally:
        q.stop()


def test_dedup_across_batches(spark, arrivals, tmp_path):
    schema = "invocation_id bigint, sequence_number bigint, t bigint"
    stream = arrivals([[(1, 1, 10), (1, 2, 11)], [(1, 2, 12), (1, 3, 13), (2, 1, 13)], [(1, 1, 14), (1, 3, 15)]], schema)
    stream = stream.withColumn("ts", F.timestamp_seconds("t"))
    out = drain(spark, S.dedup_stream(stream, ["invocation_id", "sequence_number"], "ts", "1 hour"), tmp_path)
    assert sorted((r.invocation_id, r.sequence_number) for r in out.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_silence_within_and_across_batches(spark, arrivals, tmp_path):
    schema = "worker_id bigint, t bigint"
    stream = arrivals([[(1, 0), (1, 50), (2, 0)], [(1, 100), (2, 10)], [(1, 400), (3, 401)], [(3, 1000)]], schema)
    stream = stream.withColumn("ts", F.timestamp_seconds("t"))
    out = drain(spark, S.heartbeat_monitor(stream, 60), tmp_path).collect()
    found = {(r.key, r.silent_from_us // 1_000_000) for r in out}
    # worker 1 went silent at 100 and at 400, worker 2 at 10, worker 3 at 401
    assert found == {(1, 100), (1, 400), (2, 10), (3, 401)}


def test_heartbeats_out_of_order_over_batches(spark, arrivals, tmp_path):
    # worker 1 is heard every 30 s, one file of it a batch late; worker 2 is silent from 30 to 200; the row at 5 is too late
    stream = arrivals(
        [[(1, 0), (1, 30), (2, 0), (2, 30)], [(1, 150), (1, 180), (2, 200)], [(1, 60), (1, 90), (1, 120)], [(1, 210), (2, 230)], [(3, 1000)], [(1, 5), (3, 1030)]],
        "worker_id bigint, t bigint",
    )
    out = drain(spark, S.heartbeat_monitor(stream.withColumn("ts", F.timestamp_seconds("t")), 60, lateness_seconds=150), tmp_path).collect()
    second = lambda us: us and us // 1_000_000
    found = sorted((r.key, second(r.silent_from_us), second(r.heard_again_us) or 0) for r in out if r.late_us is None)
    assert found == [(1, 210, 0), (2, 30, 200), (2, 230, 0)]
    assert [(r.key, second(r.late_us)) for r in out if r.late_us is not None] == [(1, 5)]


def test_late_end_of_a_build(spark, arrivals, tmp_path):
    batches = [[(1, "Progress", 0), (2, "Progress", 0)], [(3, "Progress", 100)], [(1, "BuildFinished", 20)], [(3, "BuildFinished", 1000)]]
    stream = arrivals(batches, "invocation_id bigint, kind string, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    out = drain(spark, S.open_build_timeout(stream, 300, lateness_seconds=10), tmp_path).collect()
    assert sorted((r.key, r.silent_from_us) for r in out if r.late_us is None) == [(2, 0), (3, 100_000_000)]
    assert [(r.key, r.late_us) for r in out if r.late_us is not None] == [(1, 20_000_000)]


def test_latest_worker_state_in_any_order(spark, arrivals):
    rows = [[(1, 50, 1, 1), (2, 10, 1, 0)], [(1, 20, 2, 0), (2, 10, 2, 2)]]
    stream = arrivals(rows, "worker_id bigint, t bigint, seq bigint, state_code int").withColumn("ts", F.timestamp_seconds("t"))
    stream = stream.withColumn("execution_id", F.col("seq")).withColumn("percent_complete", F.lit(0.5))
    q = S.latest_worker_state(stream).writeStream.format("memory").queryName("latest_state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.worker_id, r.state_code) for r in spark.table("latest_state").collect()) == [(1, 1), (2, 2)]


def test_live_summary_equals_batch_summary(spark, sf_dir, tmp_path):
    live = S.live_build_summary(D.build_events(spark, sf_dir, D.stream_table))
    S.upsert_summaries(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    columns = ["invocation_id", "status", "command", "total_actions", "cached_actions", "local_actions", "failed_actions"]
    got = read_summary(spark, str(tmp_path / "out")).select(columns)
    want = B.build_summary(D.build_events(spark, sf_dir), targets=False).select(columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_ingest_resumes_where_it_stopped(spark, tmp_path):
    schema = "sequence_number bigint, type_url string, payload string"
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for batch in ([(1, "a/BuildEvent", "{}"), (2, "a/Other", "{}"), (3, "", None)], [(4, "", "{}")]):
        spark.createDataFrame(batch, schema).write.mode("append").json(src)
        S.ingest_event_stream(spark.readStream.schema(schema).json(src), out, cp)
    assert sorted(r.sequence_number for r in spark.read.parquet(out).collect()) == [1, 4]


def test_versions_of_a_new_checkpoint_stay_behind(spark, arrivals, tmp_path):
    """The newest summary holds when the log is read again from its beginning, batch by batch."""
    schema = (
        "invocation_id bigint, kind string, sequence_number bigint, command string, start_time string, end_time string, overall_success boolean, "
        "exit_code int, success boolean, remote_cache_hits bigint, cached_remotely boolean"
    )
    row = lambda kind, seq, **x: (1, kind, seq, x.get("command"), "2024-01-01T00:00:00Z", None, x.get("ok"), None, x.get("success"), None, None)
    batches = [[row("BuildStarted", 0, command="build")], [row("ActionExecuted", 2, success=True)], [row("BuildFinished", 9, ok=True)], [row("ActionExecuted", 5, success=False)]]
    out = str(tmp_path / "out")
    live = S.live_build_summary(arrivals(batches, schema))
    S.upsert_summaries(live, out, str(tmp_path / "cp1"))
    first = read_summary(spark, out).collect()
    assert [(r.status, r.total_actions, r.failed_actions) for r in first] == [("success", 2, 1)]
    early = spark.createDataFrame(batches[0], schema)
    folder = str(tmp_path / "early")
    early.coalesce(1).write.json(folder)
    S.upsert_summaries(S.live_build_summary(spark.readStream.schema(schema).json(folder)), out, str(tmp_path / "cp2"))
    assert read_summary(spark, out).collect() == first


def test_compacted_summaries(spark, tmp_path):
    import os

    from buildlens.sources import history

    path = str(tmp_path / "s")
    put = lambda version, *rows: history.write_summary(spark.createDataFrame(rows, "invocation_id string, start_time string, status string"), path, version=version)
    read = lambda: {r.invocation_id: r.status for r in read_summary(spark, path).collect()}
    put(1, ("a", "2024-01-05", "old"), ("b", "2024-02-05", "b1"), ("c", None, "c1"), ("d", "x/y", "d1"))
    put(3, ("a", "2024-01-05", "new"))
    want = {"a": "new", "b": "b1", "c": "c1", "d": "d1"}
    assert read() == want
    assert history.compact_summaries(spark, path) == ["2024-01", "2024-02", "unknown"]
    assert read() == want and history.compact_summaries(spark, path) == []
    folders, covered, fresh = history._parts(spark, path)
    assert not fresh and len(covered) >= 3 and spark.read.parquet(*folders.values()).count() == 4
    put(2, ("a", "2024-01-05", "stale"))  # written again from an old place: loses
    put(4, ("c", "2024-02-09", "c4"))  # its start is known now, so it moves to another month
    want["c"] = "c4"
    assert read() == want
    january = folders["unknown"]
    assert history.compact_summaries(spark, path) == ["2024-01", "2024-02"]
    assert read() == want and history._parts(spark, path)[0]["unknown"] == january
    # a run that broke off before its manifest leaves nothing that is read
    os.makedirs(f"{path}/_compacted/broken")
    assert read() == want


def test_append_order_of_several_files(spark, tmp_path):
    from buildlens import schemas
    from buildlens.sources import history

    path = str(tmp_path / "h")
    label = spark.range(40).select(F.format_string("t%02d", "id").alias("label"))
    assert "label" in schemas.TARGET_HISTORY
    history.append_target_history(label.repartitionByRange(5, "label"), path)
    history.append_target_history(label.withColumn("label", F.concat(F.lit("u"), "label")).repartitionByRange(3, "label"), path)
    got = [r.label for r in history.read_target_history(spark, path).orderBy("ingest_order").collect()]
    assert got == [f"t{k:02d}" for k in range(40)] + [f"ut{k:02d}" for k in range(40)]
