"""Common table expressions for the SQL oracles: the stand-ins written a second time, in plain SQL."""

from __future__ import annotations

DAY = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))"
LINE_SEQ = f"({DAY.format('l_shipdate')} * 16 + l_linenumber)"
RFC = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g+00:00')"
TOOK = "(CASE WHEN l_discount = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END)"
HIT = f"((l_tax = 0.08) OR (l_returnflag <> 'R' AND {TOOK} = 0))"
STATUS_CODE = "(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 + l_linenumber % 6 END)"
STATUS_NAME = (
    f"(CASE {STATUS_CODE} WHEN 1 THEN 'PASSED' WHEN 2 THEN 'FLAKY' WHEN 3 THEN 'TIMEOUT' WHEN 4 THEN 'FAILED' "
    "WHEN 5 THEN 'INCOMPLETE' WHEN 6 THEN 'REMOTE_FAILURE' WHEN 7 THEN 'FAILED_TO_BUILD' "
    "ELSE 'TOOL_HALTED_BEFORE_TESTING' END)"
)
BUILD_STATUS = "(CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failure' ELSE 'in_progress' END)"

CTE = {
    "act": f"""SELECT l_orderkey AS inv, CAST(l_partkey AS VARCHAR) AS label, l_suppkey AS worker, {LINE_SEQ} AS seq,
        l_returnflag <> 'R' AS ok, {TOOK} AS took, {HIT} AS hit, l_linenumber, l_linestatus, l_returnflag, l_tax,
        l_discount, l_shipdate, l_quantity, l_extendedprice, l_suppkey FROM lineitem""",
    "metrics": """SELECT inv, label, count(*) AS action_count, CAST(sum(took) AS BIGINT) AS action_duration_ms,
        count(*) FILTER (WHERE hit) AS cached_actions, count(*) FILTER (WHERE NOT ok) AS failed_actions
        FROM act GROUP BY inv, label""",
    "done": """SELECT inv, label, bool_and(ok) AS success, max(l_shipdate) AS event_ts FROM act GROUP BY inv, label""",
    "seen": """SELECT inv, label, min(seq) AS first_seq FROM act GROUP BY inv, label""",
    "summary": f"""SELECT o_orderkey AS inv, o_orderpriority AS command, CAST(o_custkey AS VARCHAR) AS workspace,
        {RFC.format('o_orderdate')} AS start_time,
        CASE WHEN o_orderstatus <> 'O' THEN {RFC.format('o_orderdate + to_seconds(CAST(floor(o_totalprice) AS BIGINT))')}
        END AS end_time,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice) AS BIGINT) * 1000 ELSE 0 END AS duration_ms,
        {BUILD_STATUS} AS status,
        coalesce(n, 0) AS total_actions, coalesce(c, 0) AS cached_actions, coalesce(lo, 0) AS local_actions,
        coalesce(f, 0) AS failed_actions,
        o_custkey % 7 + coalesce((SELECT count(*) FROM act WHERE act.inv = o_orderkey AND l_linestatus = 'F'
            AND l_tax = 0 AND seq > ({DAY.format('o_orderdate')} + 30) * 16), 0) AS remote_cache_hits,
        coalesce(ct, 0) AS cached_test_results
        FROM orders LEFT JOIN (SELECT inv, count(*) AS n, count(*) FILTER (WHERE ok AND took = 0) AS c,
            count(*) FILTER (WHERE ok AND took > 0) AS lo, count(*) FILTER (WHERE NOT ok) AS f,
            count(*) FILTER (WHERE l_linestatus = 'F' AND l_discount = 0) AS ct FROM act GROUP BY inv) a
        ON a.inv = o_orderkey""",
    "tst": f"""SELECT l_orderkey AS inv, CAST(l_partkey AS VARCHAR) AS label, {STATUS_NAME} AS status,
        l_discount = 0 AS cl, l_tax = 0 AS cr, l_shipdate, CAST(l_quantity AS BIGINT) AS duration_ms,
        row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS pos
        FROM lineitem WHERE l_linestatus = 'F'""",
    "execs": """SELECT done.inv, done.label, coalesce(p_type, '') AS target_kind, string_split(p_name, ' ') AS tags,
        CASE WHEN success THEN 'success' ELSE 'failure' END AS status, event_ts,
        row_number() OVER (ORDER BY event_ts, done.inv) AS pos, metrics.action_count, metrics.action_duration_ms,
        metrics.cached_actions, metrics.failed_actions, start_time, end_time, duration_ms, command, workspace,
        summary.status AS build_status
        FROM done JOIN metrics USING (inv, label) LEFT JOIN part ON p_partkey = CAST(done.label AS BIGINT)
        LEFT JOIN summary ON summary.inv = done.inv""",
    "env": """SELECT o_orderkey AS inv, 'PRIORITY' AS key, o_orderpriority AS value FROM orders
        UNION ALL SELECT o_orderkey, 'OWNER', 'x=' || o_custkey FROM orders
        UNION ALL SELECT o_orderkey, 'OPEN', '' FROM orders WHERE o_orderstatus = 'O'""",
    "ev": """SELECT event_id AS seq, ts, user_id, event_type, value, epoch_us(ts) AS us,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 1000) AS BIGINT) AS milli
        FROM events""",
    "docs": """SELECT doc_id, text, lang, source, n_chars, sha256(text) AS hash, strlen(text) AS size_bytes
        FROM documents""",
    "store": """SELECT hash, size_bytes, min(doc_id) AS first_doc FROM docs
        WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY hash, size_bytes""",
    "req": """SELECT doc_id AS request_id, hash, size_bytes FROM docs
        UNION ALL SELECT item_id + 1000000000, sha256(text), strlen(text) FROM benchmark""",
    "trans": """SELECT seq, ts, us, user_id AS op, CASE event_type WHEN 'signup' THEN 'Queued' WHEN 'view' THEN 'Assigned'
        WHEN 'click' THEN 'Downloading' WHEN 'purchase' THEN 'Executing' ELSE 'Failed' END AS stage FROM ev""",
    "conn": """SELECT seq, ts, us, user_id AS worker, milli AS rtt_us, CASE event_type WHEN 'signup' THEN 'connected'
        WHEN 'purchase' THEN 'disconnected' WHEN 'error' THEN 'health_check_failed'
        ELSE 'health_check_passed' END AS event FROM ev""",
    "nodes": """SELECT sha256('world') AS dir_hash, r_name AS name, sha256(r_name) AS child_hash, 0 AS child_size,
        true AS is_dir, false AS is_exec FROM region
        UNION ALL SELECT sha256(r_name), n_name, sha256(n_name), 0, true, false
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT sha256(n_name), c_name, sha256(string_split(c_name, '#')[2]),
        strlen(string_split(c_name, '#')[2]), false, c_acctbal > 0 FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT sha256(n_name), s_name, sha256(string_split(s_name, '#')[2]),
        strlen(string_split(s_name, '#')[2]), false, s_acctbal > 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
}

# What each expression reads, so that a query names only what it needs itself.
NEEDS = {
    "metrics": ["act"],
    "done": ["act"],
    "seen": ["act"],
    "summary": ["act"],
    "execs": ["act", "metrics", "done", "summary"],
    "store": ["docs"],
    "req": ["docs"],
    "trans": ["ev"],
    "conn": ["ev"],
}


def with_ctes(names: str, body: str, **extra: str) -> str:
    """``WITH`` the named expressions and what they read, then ``extra`` ones, then the body."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({CTE[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
