"""Native fixtures: the corner cases that the driver tables do not hold."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from buildlens.functions import exprs as X
from buildlens.operators import benchmarks as M
from buildlens.operators import builds as B
from buildlens.operators import execution as E
from buildlens.operators import store as S
from buildlens.operators import targets as T
from buildlens.operators import trees
from buildlens.operators import workers as W
from buildlens.plans import ranks as R
from buildlens.sources import bench_results, event_log, history, inventory


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def log(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("log")

    def event(kind, payload, id_=None, last=False, children=()):
        return json.dumps({"last_message": last, "id": id_ or kind, "children": list(children), "payload": {kind: payload}})

    t = "2024-01-01T00:00:0{}+00:00"
    lines = [
        event("Started", {"command": "test", "workspace_directory": "/w", "start_time": t.format(0)}, "BuildStarted",
              children=[{"pattern": ["//a", "//b"]}, {"target_completed": {"label": "//late"}}, {"other": "x"}]),
        "",
        "   ",
        '{"broken',
        "[1, 2]",
        event("UnstructuredCommandLine", {"args": ["--client_env=A=1=2", "--action_env=A", "--test_env=B", "--repo_env=C=",
                                                     "x--test_env=D=1--test_env=D=2"]}),
        event("ActionExecuted", {"success": True, "type": "Cc", "label": "//a", "start_time": t.format("1.000000001"),
                                 "end_time": t.format("1.000000002")}, "ActionCompleted://a"),
        event("ActionExecuted", {"success": True, "label": "//a", "start_time": t.format(2), "end_time": t.format(2)},
              "ActionCompleted://a"),
        event("ActionExecuted", {"success": True, "label": "", "start_time": t.format(4), "end_time": t.format(3)},
              "ActionCompleted:"),
        event("ActionExecuted", {"success": False, "exit_code": 7, "label": "//b"}, "ActionCompleted://b"),
        event("TestResult", {"status": 1, "cached_locally": True, "cached_remotely": True}, "TestResult://t"),
        event("BuildMetrics", {"remote_cache_hits": 5}),
        event("TestResult", {"status": 8, "cached_remotely": True}, "TestResult://t"),
        event("TestSummary", {"overall_status": 1, "total_num_cached": 3}, "TestSummary://t"),
        event("Configured", {"target_kind": "cc_library rule"}, "TargetConfigured://late"),
        event("Finished", {"overall_success": False, "exit_code": 0, "finish_time": t.format(9)}, "BuildFinished"),
        event("Completed", {"success": True, "tag": ["x"]}, "TargetCompleted://late", last=True),
        event("Progress", {"stdout": "out"}),
    ]
    for name, body in (("inv-1", lines), ("inv-2", lines[:1])):
        os.makedirs(root / name)
        (root / name / "events.jsonl").write_text("\n".join(body) + "\n")
    events, bad = event_log.read_event_log(spark, str(root))
    return events, bad


@pytest.fixture(scope="module")
def flat(log):
    return event_log.normalize_event(log[0], order="line_order").cache()


def test_log_lines(log):
    events, bad = log
    assert events.filter("invocation_id = 'inv-1'").count() == 14
    assert sorted(r.line for r in bad.collect()) == ['[1, 2]', '{"broken']


def test_normalize(flat):
    by_id = {r.id: r for r in flat.filter("invocation_id = 'inv-1'").collect()}
    assert by_id["TargetCompleted://late"].label == "//late" and by_id["TargetCompleted://late"].kind == "TargetComplete"
    assert by_id["TargetCompleted://late"].tags == ["x"] and by_id["TargetCompleted://late"].last_message
    assert by_id["TargetConfigured://late"].target_kind == "cc_library rule"
    assert by_id["ActionCompleted://b"].start_time is None and by_id["ActionCompleted://b"].exit_code == 7
    assert by_id["Progress"].timestamp is None and by_id["Progress"].label is None
    assert by_id["BuildFinished"].timestamp == "2024-01-01T00:00:09+00:00"


def test_lines_as_the_log_has_them(spark, tmp_path):
    """Envelope, children and payload as written by the service, for every kind of payload."""
    t = "2024-05-06T07:08:0{}+00:00".format

    def line(kind, payload, id_, time=None, last=False):
        variant = next(iter(payload))
        return json.dumps({"children": [], "id": id_, "kind": kind, "last_message": last, "payload": {variant: payload[variant]}, "timestamp": time})

    empty = ["NamedSetOfFiles", "BuildToolLogs", "TargetSummary", "ConvenienceSymlinksIdentified", "ExecRequest", "TestProgress"]
    lines = [
        line("BuildStarted", {"Started": {"uuid": "u", "command": "test", "workspace_directory": "/w", "working_directory": "/w/d",
                                          "build_tool_version": "8.0.0", "start_time": t(1)}}, "BuildStarted", t(1)),
        line("TestResult", {"TestResult": {"status": 1, "cached_locally": False, "cached_remotely": None}}, "TestResult://t", t(3)),
        line("TestSummary", {"TestSummary": {"overall_status": 1, "total_run_count": 2, "total_num_cached": 0}}, "TestSummary://t", t(2)),
        line("Progress", {"Progress": {"stdout": "o", "stderr": "e"}}, "Progress"),
        line("Aborted", {"Aborted": {"reason": 3, "description": "d"}}, "TargetCompleted://x"),
        line("WorkspaceInfo", {"WorkspaceInfo": {"local_exec_root": "/r"}}, "Unknown"),
        line("BuildMetadata", {"BuildMetadata": {"metadata": {"k": "v"}}}, "BuildMetadata"),
        line("Configuration", {"Configuration": {"mnemonic": "m", "platform_name": "p", "cpu": "c"}}, "Configuration"),
        line("TargetConfigured", {"Configured": {"target_kind": "rule", "actual": "//z"}}, "TargetConfigured://y"),
        line("OptionsParsed", {"OptionsParsed": {"cmd_line": ["--a"], "startup_options": ["--s"]}}, "OptionsParsed"),
        line("WorkspaceStatus", {"WorkspaceStatus": {"item": [{"key": "USER", "value": "n"}]}}, "WorkspaceStatus"),
        line("StructuredCommandLine", {"StructuredCommandLine": {"type_url": "x/y"}}, "StructuredCommandLine"),
        line("PatternExpanded", {"Expanded": {}}, "Pattern://a"),
        line("SkyValueUploaded", {"SkyvalueUploaded": {}}, "SkyValueUploaded"),
        *[line(kind, {kind: {}}, kind) for kind in empty],
        line("TargetComplete", {"Completed": {"success": False, "tag": [], "failure_detail": "compile"}}, "TargetCompleted://x"),
        line("TargetComplete", {"Completed": {"success": True, "tag": [], "failure_detail": "none"}}, "TargetCompleted://y"),
        line("BuildFinished", {"Finished": {"overall_success": False, "exit_code": 1, "finish_time": t(9), "failure_detail": "stopped"}},
             "BuildFinished", t(9), last=True),
    ]
    (tmp_path / "inv").mkdir()
    (tmp_path / "inv" / "events.jsonl").write_text("\n".join(lines))
    flat = event_log.normalize_event(event_log.read_event_log(spark, str(tmp_path))[0], order="line_order").cache()
    rows = flat.collect()
    assert sorted(r.kind for r in rows) == sorted(json.loads(x)["kind"] for x in lines)
    by_kind = {r.kind: r for r in rows}
    assert by_kind["TestResult"].timestamp == t(3) and by_kind["TestResult"].test_start_ts == by_kind["TestResult"].event_ts
    assert by_kind["TestResult"].event_ts is not None and by_kind["TestSummary"].timestamp == t(2)
    assert by_kind["TestSummary"].test_start_ts is None and by_kind["Progress"].event_ts is None
    assert (by_kind["BuildStarted"].uuid, by_kind["BuildStarted"].working_directory) == ("u", "/w/d")
    assert (by_kind["Progress"].stdout, by_kind["Progress"].stderr) == ("o", "e")
    assert (by_kind["Aborted"].abort_reason, by_kind["Aborted"].abort_description) == ("3", "d")
    assert by_kind["WorkspaceInfo"].local_exec_root == "/r" and by_kind["BuildMetadata"].metadata == {"k": "v"}
    conf = by_kind["Configuration"]
    assert (conf.mnemonic, conf.platform_name, conf.cpu, by_kind["TargetConfigured"].actual) == ("m", "p", "c", "//z")
    assert (by_kind["OptionsParsed"].cmd_line, by_kind["OptionsParsed"].startup_options) == (["--a"], ["--s"])
    assert by_kind["WorkspaceStatus"].workspace_status[0].asDict() == {"key": "USER", "value": "n"}
    assert by_kind["StructuredCommandLine"].command_line_type == "x/y"
    summary = B.build_summary(flat, errors=True).first()
    assert (summary.status, summary.errors, summary.duration_ms) == ("failure", ["compile", "stopped"], 8000)
    assert sorted(r.error for r in B.build_errors(flat).collect()) == ["compile", "stopped"]


def test_edges(log):
    edges = event_log.event_edges(log[0].filter("invocation_id = 'inv-2'")).collect()
    assert sorted((r.child_id, r.child_label) for r in edges) == [
        ("Pattern://a,//b", None), ("TargetCompleted://late", "//late"), ("Unknown", None)]


def test_summary(flat):
    s = {r.invocation_id: r for r in B.build_summary(flat).collect()}
    done, running = s["inv-1"], s["inv-2"]
    assert (done.status, done.duration_ms, done.command) == ("success", 9000, "test")  # exit code 0 is enough
    # same microsecond but other nanoseconds is no cache hit; a backward span is local; no times and failed
    assert (done.total_actions, done.cached_actions, done.local_actions, done.failed_actions) == (4, 1, 2, 1)
    assert done.remote_cache_hits == 6  # metrics overwrite the hit before them, the one after is added
    assert done.targets == ["//a", "//b", "//late"]
    assert (done.cached_test_results, done.cached_test_runs) == (1, 3)
    assert (running.status, running.end_time, running.total_actions, running.duration_ms) == ("in_progress", None, 0, 0)
    compat = B.build_summary(flat, compat=True).filter("invocation_id = 'inv-1'").first()
    assert compat.cached_actions == 1 + 1 + 3


def test_misses_and_metrics(flat):
    actions = flat.filter("kind = 'ActionExecuted'")
    misses = sorted((r.label, r.success, r.exit_code, r.duration_ms) for r in B.cache_misses(actions).collect())
    # one nanosecond apart is a miss of 0 ms; a backward span has no duration
    assert misses == [("", True, None, None), ("//a", True, None, 0), ("//b", False, 7, None)]
    metrics = {r.label: r for r in B.action_metrics(actions).collect()}
    assert set(metrics) == {"//a", "//b"}  # the blank label is skipped
    assert (metrics["//a"].action_count, metrics["//a"].cached_actions) == (2, 2)  # below a millisecond counts here
    assert (metrics["//b"].cached_actions, metrics["//b"].failed_actions) == (0, 1)
    audit = {(r.summary_rule, r.metrics_rule, r.miss_rule): r.actions for r in B.cache_rule_audit(actions).collect()}
    assert audit == {(True, True, True): 1, (False, True, False): 1, (False, False, False): 2}


def test_env(flat):
    got = {r.key: r.value for r in B.build_env(flat.filter("args is not null")).collect()}
    assert got == {"A": "1=2", "B": "", "C": "", "D": "2"}


def test_env_order(spark):
    rows = [
        ("i", 1, ["--action_env=K", "--action_env=Z=1"]),
        ("i", 2, ["--client_env=K=new", "--action_env=Z=2"]),
        ("j", 1, ["--action_env=K", "--client_env=K=same"]),
        ("k", 1, ["--client_env=K=old"]),
        ("k", 2, ["--test_env=K", "--action_env=K2=a", "--repo_env=K2=b"]),
    ]
    df = spark.createDataFrame(rows, "invocation_id string, sequence_number bigint, args array<string>")
    got = {(r.invocation_id, r.key): r.value for r in B.build_env(df).collect()}
    # a bare key sees client values up to its own event, in whatever place they stand there
    assert got == {("i", "K"): "", ("i", "Z"): "2", ("j", "K"): "same", ("k", "K"): "old", ("k", "K2"): "b"}


def test_tests(spark):
    rows = [("//t", 1, s, False, None, i) for i, s in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, None])]
    df = spark.createDataFrame(
        rows, "label string, invocation_id int, test_status int, cached_locally boolean, cached_remotely boolean, ingest_order int"
    ).withColumns({"start_ts": F.lit(None).cast("timestamp"), "duration_ms": F.lit(None).cast("bigint")})
    runs = T.test_executions(df)
    r = one(T.test_rollup(runs))
    assert (r["total_runs"], r["passed_count"], r["failed_count"], r["flaky_count"], r["cached_count"]) == (10, 1, 6, 1, 0)
    assert r["latest_status"] == "NO_STATUS"
    assert {x.status_group: x.runs for x in T.test_status_mix(runs).collect()} == {"pass": 1, "fail": 6, "flaky": 1, "other": 2}


def test_digests(spark):
    h = "ab" * 32
    rows = [("s", h), ("s", h.upper()), ("s", h[:-1]), ("s", "g" + h[1:]), ("s", h + "-12"), ("s", h + "-x"), ("s", "")]
    r = one(S.digest_audit(spark.createDataFrame(rows, "source string, digest string"), "source"))
    assert (r["digests"], r["valid"], r["canonical"], r["malformed"], r["sized_bytes"]) == (7, 3, 2, 4, 12)


def test_resource_names(spark):
    rows = ["uploads/u/blobs/ab/12", "blobs/ab/12", "ab/x", "12", "ab/1.5", "ab/ 7", "ab/-3"]
    df = spark.createDataFrame([(r,) for r in rows], "resource string")
    got = sorted(((r.hash, r.size_bytes, r.unread, r.requests) for r in S.resource_traffic(df).collect()), key=repr)
    assert got == sorted(
        [("ab", 12, None, 2), ("ab", -3, None, 1)] + [(None, None, r, 1) for r in ("ab/x", "12", "ab/1.5", "ab/ 7")], key=repr
    )


def test_missing_keeps_request_order_and_maps_by_hash(spark):
    req = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, "a", 1)], "request_id int, hash string, size_bytes int")
    store = spark.createDataFrame([("a", 1)], "hash string, size_bytes int")
    assert sorted(r.request_id for r in S.find_missing_blobs(req, store).collect()) == [1, 2, 3, 4]


def test_placement_limits(spark):
    df = spark.createDataFrame([(i, b"x" * n) for i, n in enumerate([0, 9, 10, 20, 21])], "i int, content binary")
    got = {r.i: (r.placement, r.kept_bytes, r.hash) for r in S.place_outputs(df, max_capture=20, inline_limit=10).collect()}
    sha = lambda n: hashlib.sha256(b"x" * n).hexdigest()
    assert got == {0: ("inline", 0, None), 1: ("inline", 9, None), 2: ("stored", 10, sha(10)), 3: ("stored", 20, sha(20)),
                   4: ("truncated", 20, sha(20))}


def test_range_read_edges(spark):
    store = spark.createDataFrame([("h", b"abcdef")], "hash string, content binary")
    req = spark.createDataFrame([(1, "h", 0, 0), (2, "h", 4, 9), (3, "h", 6, 0), (4, "h", 99, 1), (5, "h", 1, 2)],
                                "request_id int, hash string, offset bigint, limit bigint")
    got = {r.request_id: (bytes(r.slice), r.bytes) for r in S.range_read(req, store).collect()}
    assert got == {1: (b"abcdef", 6), 2: (b"ef", 2), 3: (b"", 0), 4: (b"", 0), 5: (b"bc", 2)}


def test_inventory_of_a_directory(spark, tmp_path):
    h1, h2 = "ab" * 32, "cd" * 32
    for rel in (h1, f"{h2[:2]}/{h2[2:4]}/{h2[4:]}", f".tmp/{h1}", "short", f"x/{h1}"):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"12345")
    got = sorted((r.hash, r.size_bytes) for r in inventory.scan_blob_inventory(spark, str(tmp_path)).collect())
    assert got == [(h1, 5), (h2, 5)]


def test_listing_has_a_partition_for_each_directory(spark, tmp_path):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    store = spark.createDataFrame([(h, h.encode() * i) for i, h in enumerate(hashes)], "hash string, content binary")
    inventory.write_blob_files(store, str(tmp_path))
    inventory.write_blob_files(store, f"file://{tmp_path}")  # once more changes nothing
    (tmp_path / "AB" / "cd").mkdir(parents=True)
    (tmp_path / "AB" / "cd" / ("e" * 60)).write_bytes(b"1")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        rows = inventory.scan_blob_inventory(spark, root)
        assert rows.rdd.getNumPartitions() == 257
        got = {r.hash: r.size_bytes for r in rows.collect()}
        assert got == {h: 64 * i for i, h in enumerate(hashes)} | {"abcd" + "e" * 60: 1}
    with pytest.raises(Exception, match="no-such"):
        inventory.scan_blob_inventory(spark, str(tmp_path / "no-such")).collect()


def test_versions(spark):
    rows = [("7.4.1", None), (None, "x Bazel/8.0 y"), ("bad", "bazel/9"), (None, "curl"), ("6.x.2", None), (" 10 ", None), ("-7", None)]
    df = spark.createDataFrame(rows, "header string, ua string").select(
        X.client_version(F.col("header"), F.col("ua")).alias("version"), "header", "ua")
    got = [(tuple(r.version) if r.version else None, r.handler, r.protocol) for r in E.version_range_join(df).collect()]
    assert sorted(got, key=repr) == sorted([
        ((7, 4, 1), "v7", "2.3"), ((8, 0, 0), "v8", "2.4"), ((9, 0, 0), "v9", "2.4"), (None, "default", "2.4"),
        ((6, 0, 2), "default", "2.4"), ((10, 0, 0), "v9", "2.4"), (None, "default", "2.4")], key=repr)


def test_replay_rejects_and_goes_on(spark):
    stages = ["Assigned", "Queued", "Queued", "Executing", "Assigned", "Downloading", "Completed", "Queued"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(stages)], "operation_id int, seq bigint, stage string")
    df = df.withColumn("ts", F.timestamp_seconds("seq"))
    got = E.transition_replay(df).orderBy("step").collect()
    assert [(r.step, r.stage, r.seq) for r in got] == [(1, "Queued", 1), (2, "Assigned", 4), (3, "Downloading", 5), (4, "Completed", 6)]


def test_two_requests_in_flight_merge(spark):
    df = spark.createDataFrame([("h", 1, 0, 10), ("h", 2, 5, 30), ("h", 3, 10, 20)],
                               "hash string, seq bigint, enqueued_us bigint, completed_us bigint")
    got = {r.seq: (r.merged_into, r.leader) for r in E.merge_inflight(df).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}


def test_alert_counter_is_no_streak(spark):
    # one success between failures does not reset the counter, two do
    marks = "FFPF FPPFFPF".replace(" ", "")
    df = spark.createDataFrame([(1, i, "health_check_failed" if m == "F" else "health_check_passed") for i, m in enumerate(marks)],
                               "worker_id int, seq bigint, event string").withColumn("ts", F.timestamp_seconds("seq"))
    assert sorted((r.seq, r.failures) for r in W.health_alerts(df).collect()) == [(3, 3), (4, 4), (10, 3)]


def test_latency_summary_without_success(spark):
    df = spark.createDataFrame([("a", 1.0, False), ("b", 2.0, True)], "op string, duration double, success boolean")
    got = {r.op: r for r in M.latency_summary(df, ["op"]).collect()}
    assert (got["a"].n, got["a"].p99, got["a"].median) == (0, 0.0, 0.0)
    assert (got["b"].n, got["b"].p99, got["b"].stddev) == (1, 2.0, 0.0)


def test_gate_direction_and_missing(spark):
    df = spark.createDataFrame([("r", "churn_cleanup_rate", 99.0), ("r", "memory_mb", None)], "run string, metric string, value double")
    assert {r.metric: (r.passed, r.no_data) for r in M.threshold_gate(df).collect()} == {
        "churn_cleanup_rate": (True, False), "memory_mb": (True, True)}
    assert not M.threshold_gate(df, compat=True).filter("metric = 'churn_cleanup_rate'").first().passed
    assert M.overall_status(M.threshold_gate(df)).first().status == "partial"


def test_baseline_of_zero(spark):
    cur = spark.createDataFrame([("a", 5.0), ("b", None), ("c", 9.0)], "metric string, value double")
    base = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 10.0)], "metric string, value double")
    got = {r.metric: (r.change_pct, r.status) for r in M.baseline_compare(cur, base, ["metric"]).collect()}
    assert got == {"a": (0.0, "ok"), "c": (-10.0, "ok")}


def test_sample_lines(spark):
    lines = ["0.15%|50MiB / 512MiB|9.77%|1.2MB / 800kB|0B / 0B|15", "1%|2 / 3|4%|a / b|0B / 0B|7", "only|three|parts", "",
             "1%|2MiB|3%|1B / 1B|1B / 1B|1", "x%|1B / 1B|1%|1B / 1B|1B / 1B|1"]
    good, bad = M.sample_normalize(spark.createDataFrame([(x,) for x in lines], "line string"))
    rows = good.orderBy("pids").collect()
    assert [r.pids for r in rows] == [7, 15] and bad.count() == 4
    assert rows[1].memory_usage_mb == 50 and rows[1].net_io_write_mb == pytest.approx(800 / 1024)
    assert rows[0].net_io_read_mb == 0 and rows[0].memory_usage_mb == pytest.approx(2 / 1024**2)


def test_tree_with_shared_and_empty_directories(spark):
    rows = [("r", "a", "d1", 0, True, False), ("r", "b", "d1", 0, True, False), ("r", "e", "empty", 0, True, False),
            ("d1", "f", "h1", 10, False, True), ("d1", "g", "h1", 10, False, False), ("r", "h", "h2", 5, False, False)]
    nodes = spark.createDataFrame(rows, "dir_hash string, name string, child_hash string, child_size bigint, is_dir boolean, is_executable boolean")
    roots = spark.createDataFrame([("r",)], "dir_hash string")
    flat = trees.flatten_tree(nodes, roots)
    assert sorted(r.path for r in flat.collect()) == ["a/f", "a/g", "b/f", "b/g", "h"]
    local = spark.createDataFrame([("h2",)], "hash string")
    got = one(trees.tree_stats(nodes, roots, local))
    assert got == {"root": "r", "directories": 4, "files": 5, "downloads": 1, "bytes_to_fetch": 10, "cached_files": 4}


def test_tree_digests_ignore_listing_order(spark):
    files = [("r", "a/x", "h1", True), ("r", "a/y", "h2", False), ("r", "z", "h3", False)]
    schema = "root string, path string, hash string, is_executable boolean"
    one_way = {r.path: (r.dir_hash, r.files) for r in trees.build_tree(spark.createDataFrame(files, schema)).collect()}
    other = {r.path: (r.dir_hash, r.files) for r in trees.build_tree(spark.createDataFrame(files[::-1], schema)).collect()}
    assert one_way == other and {k: v[1] for k, v in one_way.items()} == {"": 3, "a": 2}
    changed = [("r", "a/x", "h1", False), *files[1:]]
    assert {r.path: r.dir_hash for r in trees.build_tree(spark.createDataFrame(changed, schema)).collect()}[""] != one_way[""][0]


def test_history_keeps_append_order_and_skips_bad_lines(spark, tmp_path):
    path = str(tmp_path / "h")
    schema = "label string, invocation_id string, status string"
    for status in ("PASSED", "FAILED"):
        history.append_test_history(spark.createDataFrame([("//t", "i", status)], schema).coalesce(1), path)
    (tmp_path / "h" / "part-bad.json").write_text('{"label": \n\n')
    back = history.read_test_history(spark, path).filter("status is not null")
    assert [r.status for r in back.orderBy("ingest_order").collect()] == ["PASSED", "FAILED"]
    assert back.first().duration_ms == 0


def test_bench_files(spark, tmp_path):
    (tmp_path / "cache_20260101_10.json").write_text('{\n "run": "r1",\n "p99": 3.5,\n "nested": {"a": null, "b": 2}\n}\n')
    got = {r.metric: (r.text, r.value) for r in bench_results.read_bench_json(
        spark, str(tmp_path), "run", schema="run string, p99 double, nested struct<a int, b int>").collect()}
    assert got == {"p99": ("3.5", 3.5), "nested.a": ("N/A", None), "nested.b": ("2", 2.0)}
    (tmp_path / "cache_20260102_09.json").write_text("{}")
    os.utime(tmp_path / "cache_20260102_09.json", (1, 1))
    newest = bench_results.latest_run_per_family(bench_results.list_files(spark, str(tmp_path))).collect()
    assert [(r.family, r.path.split("/")[-1]) for r in newest] == [("cache", "cache_20260101_10.json")]


def test_ttl_boundary(spark):
    from buildlens.operators.cache import cache_lookup_ttl

    rows = [("h", 0, "put"), ("h", 10, "get"), ("h", 11, "get"), ("h", 20, "get"), ("h", 20, "put"), ("g", 5, "get")]
    df = spark.createDataFrame([(h, i, op, t) for i, (h, t, op) in enumerate(rows)], "hash string, seq bigint, op string, t bigint")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    got = {r.seq: r.outcome for r in cache_lookup_ttl(df, 10).collect()}
    assert got == {1: "hit", 2: "expired", 3: "hit", 5: "miss"}  # an age equal to the limit is valid; put before get


def test_values_at_ignores_nothing(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (3, 3, 3, 1, 2)], "g string, v double")
    pos = spark.createDataFrame([("a", str(i), i) for i in range(5)], "g string, name string, pos bigint")
    assert sorted((r.name, r.value) for r in R.values_at(df, ["g"], "v", pos).collect()) == [
        ("0", 1.0), ("1", 2.0), ("2", 3.0), ("3", 3.0), ("4", 3.0)]


NODE = "dir_hash string, name string, child_hash string, child_size bigint, is_dir boolean, is_executable boolean, target string"


def test_shared_subtrees_count_paths_without_expanding_them(spark):
    """60 levels of directories, each linked twice by the one above: 2^60 files, 60 rows a round at most."""
    nodes = [(f"d{k}", side, f"d{k + 1}", 0, True, False, None) for k in range(60) for side in "ab"] + [("d60", "f", "x", 7, False, False, None)]
    df = spark.createDataFrame(nodes, NODE)
    roots = spark.createDataFrame([("d0",), ("d59",)], "dir_hash string")
    none = spark.createDataFrame([], "hash string")
    uses = trees.checkpointed(trees.directory_uses(df, roots))
    assert uses.count() == 61 + 2
    assert {r.root: r.n for r in uses.groupBy("root").agg(F.sum("paths").alias("n")).collect()} == {"d0": 2**61 - 1, "d59": 3}
    got = {r.root: r for r in trees.plan_of_uses(df, uses, none).collect()}
    assert (got["d0"].files, got["d0"].downloads, got["d0"].bytes_to_fetch, got["d59"].files) == (2**60, 1, 7, 2)


def test_a_directory_below_itself(spark):
    nodes = [("a", "b", "b", 0, True, False, None), ("b", "a", "a", 0, True, False, None), ("b", "f", "x", 1, False, False, None)]
    df = spark.createDataFrame(nodes, NODE)
    roots = spark.createDataFrame([("a",)], "dir_hash string")
    assert [r.path for r in trees.flatten_tree(df, roots).collect()] == ["b/f"]
    with pytest.raises(ValueError, match="below itself"):
        trees.directory_uses(df, roots)


def test_links_of_all_kinds(spark):
    entries = {"d/f": "file", "d/e/g": "file", "x": "file"}
    links = {
        "plain": "x", "d/up": "../x", "d/here": ".", "todir": "d/e", "through": "todir/g", "d/e/back": "../../todir/../f", "chain": "through",
        "self": "self", "grow": "grow/a", "one": "two", "two": "three", "three": "one", "gone": "d/nothing", "part": "x/y", "above": "../x", "d/abs": "/x",
        "twice": "l/m", "l": "d", "d/m": "../l/f", "root": "d/..",
    }
    nodes = [("", "d", "d", 0, True, False, None), ("d", "e", "e", 0, True, False, None)]
    where = lambda p: ({"": "", "d": "d", "d/e": "e"}[p.rpartition("/")[0]], p.rpartition("/")[2])
    nodes += [(*where(p), p, 1, False, False, None) for p in entries] + [(*where(p), None, 0, False, False, t) for p, t in links.items()]
    df = spark.createDataFrame(nodes, NODE)
    roots = spark.createDataFrame([("",)], "dir_hash string")
    got = {r.path: (r.resolved, r.status) for r in trees.resolve_links(df, roots).collect()}
    assert got == {
        "plain": ("x", "file"), "d/up": ("x", "file"), "d/here": ("d", "directory"), "todir": ("d/e", "directory"), "through": ("d/e/g", "file"),
        "d/e/back": ("f", "dangling"), "chain": ("d/e/g", "file"), "self": (None, "loop"), "grow": (None, "loop"), "one": (None, "loop"),
        "two": (None, "loop"), "three": (None, "loop"), "gone": ("d/nothing", "dangling"), "part": ("x/y", "dangling"), "above": (None, "outside"),
        "d/abs": (None, "outside"), "twice": ("d/f", "file"), "l": ("d", "directory"), "d/m": ("d/f", "file"), "root": ("", "directory"),
    }
    assert sorted(r.path for r in trees.flatten_tree(df, roots).collect()) == sorted(entries)
    assert trees.resolve_links(df.filter("target IS NULL"), roots).count() == 0


def test_tree_digests_cover_links(spark):
    schema = "root string, path string, hash string, is_executable boolean, target string"
    digest = lambda target: {r.path: r.dir_hash for r in trees.build_tree(spark.createDataFrame([("r", "a/f", "h", False, None), ("r", "a/l", None, None, target)], schema)).collect()}
    assert digest("f")["a"] != digest("g")["a"] and digest("f")[""] != digest("g")[""] and digest("f") == digest("f")
