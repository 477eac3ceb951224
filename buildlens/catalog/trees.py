"""Registered queries for directory trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlens.catalog.sqltext import with_ctes
from buildlens.functions import exprs as X
from buildlens.operators import trees as T
from buildlens.plans import standins as D

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def roots(s, d):
    """The world and every region as a root of its own, so that subtrees are shared."""
    regions = D.table(s, d, "region").select(X.digest_of(F.col("r_name")).alias("dir_hash"))
    return regions.unionByName(regions.select(X.digest_of(F.lit("world")).alias("dir_hash")).distinct())


def local(s, d):
    """Digests already on the worker: those of the customers with a positive balance."""
    c = D.table(s, d, "customer").filter("c_acctbal > 0")
    return c.select(X.digest_of(F.substring_index("c_name", "#", -1)).alias("hash"))


LOCAL = "SELECT DISTINCT sha256(string_split(c_name, '#')[2]) AS hash FROM customer WHERE c_acctbal > 0"
DIRS = (
    "SELECT sha256(r_name) AS root, sha256(r_name) AS dir_hash, '' AS path FROM region UNION ALL SELECT sha256('world'), "
    "sha256('world'), '' UNION ALL SELECT dirs.root, nodes.child_hash, CASE WHEN path = '' THEN name ELSE path || '/' || name END "
    "FROM dirs JOIN nodes USING (dir_hash) WHERE nodes.is_dir"
)
FLAT = (
    "SELECT root, CASE WHEN path = '' THEN name ELSE path || '/' || name END AS path, child_hash AS hash, child_size AS size_bytes, "
    "is_exec AS is_executable FROM dirs JOIN nodes USING (dir_hash) WHERE NOT is_dir"
)


def tree_sql(body: str, **extra: str) -> str:
    sql = with_ctes("nodes", body, dirs=DIRS, flat=FLAT, local=LOCAL, **extra)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("flatten_tree", tree_sql("SELECT * FROM flat"))
def _(s, d):
    return T.flatten_tree(D.tree_nodes(s, d), roots(s, d))


@query("get_tree", tree_sql("SELECT root, path, dir_hash FROM dirs"))
def _(s, d):
    return T.get_tree(D.tree_nodes(s, d), roots(s, d))


@query("local_cache_split", tree_sql("SELECT flat.*, hash IN (SELECT hash FROM local) AS is_local FROM flat"))
def _(s, d):
    return T.local_cache_split(T.flatten_tree(D.tree_nodes(s, d), roots(s, d)), local(s, d))


PLAN = (
    "SELECT root, CAST(sum(n) AS BIGINT) AS files, count(*) FILTER (WHERE NOT l) AS downloads, CAST(coalesce(sum(size_bytes) FILTER "
    "(WHERE NOT l), 0) AS BIGINT) AS bytes_to_fetch, CAST(sum(n) AS BIGINT) - count(*) FILTER (WHERE NOT l) AS cached_files FROM "
    "(SELECT root, hash, size_bytes, count(*) AS n, hash IN (SELECT hash FROM local) AS l FROM flat GROUP BY root, hash, size_bytes) "
    "GROUP BY root"
)


@query("tree_plan", tree_sql(PLAN))
def _(s, d):
    return T.tree_plan(D.tree_nodes(s, d), roots(s, d), local(s, d))


@query(
    "tree_stats",
    tree_sql(
        "SELECT root, (SELECT count(*) FROM dirs WHERE dirs.root = d.root) AS directories, coalesce(files, 0) AS files, "
        "coalesce(downloads, 0) AS downloads, coalesce(bytes_to_fetch, 0) AS bytes_to_fetch, coalesce(cached_files, 0) AS cached_files "
        "FROM (SELECT DISTINCT root FROM dirs) d LEFT JOIN plan USING (root)",
        plan=PLAN,
    ),
)
def _(s, d):
    return T.tree_stats(D.tree_nodes(s, d), roots(s, d), local(s, d))


LINKED = (
    "SELECT r_name AS r, n_name AS n, c_name AS c, c_custkey AS k, sha256(r_name) AS region FROM customer JOIN nation ON c_nationkey = "
    "n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
ROOTED = (
    "SELECT sha256('world') AS root, r || '/' || n AS above, * FROM linked UNION ALL SELECT region, n, * FROM linked"
)
RESOLVED = (
    "SELECT root, above, k, k % 6 AS kind, CASE k % 6 WHEN 0 THEN c WHEN 1 THEN '../' || n WHEN 2 THEN 'gone' WHEN 3 THEN 'l' || k WHEN "
    "4 THEN '../.././' || r || '/' || n || '/' || c ELSE '/' || c END AS target, CASE WHEN k % 6 = 0 OR (k % 6 = 4 AND above <> n) THEN "
    "above || '/' || c WHEN k % 6 = 1 THEN above WHEN k % 6 = 2 THEN above || '/gone' END AS resolved, CASE WHEN k % 6 = 0 OR (k % 6 = "
    "4 AND above <> n) THEN 'file' WHEN k % 6 = 1 THEN 'directory' WHEN k % 6 = 2 THEN 'dangling' WHEN k % 6 = 3 THEN 'loop' ELSE "
    "'outside' END AS status FROM rooted"
)


@query(
    "resolve_links",
    "WITH linked AS (" + LINKED + "), rooted AS (" + ROOTED + "), resolved AS (" + RESOLVED + ") "
    "SELECT root, above || '/l' || k AS path, target, resolved, status FROM resolved UNION ALL "
    "SELECT root, above || '/m' || k, 'l' || k, resolved, status FROM resolved",
)
def _(s, d):
    """Two links for each customer: one to its file, its directory, nothing, itself, around by the root or outside, and one to
    that link."""
    return T.resolve_links(D.linked_nodes(s, d), roots(s, d))


@query(
    "verify_tree",
    with_ctes(
        "nodes",
        "SELECT dir_hash, name, child_hash, CASE WHEN ok IS NULL THEN 'missing' ELSE 'corrupt' END AS problem FROM nodes LEFT JOIN k ON "
        "child_hash = hash WHERE NOT is_dir AND ok IS NOT true UNION ALL SELECT dir_hash, name, child_hash, 'missing' FROM nodes WHERE "
        "is_dir AND child_hash NOT IN (SELECT dir_hash FROM nodes)",
        k="SELECT sha256(CASE WHEN c_nationkey = 3 THEN 'elsewhere ' ELSE '' END || string_split(c_name, '#')[2]) AS hash, "
        "bool_or(c_acctbal > 0) AS ok FROM customer GROUP BY 1",
    ),
)
def _(s, d):
    text = F.substring_index("c_name", "#", -1)
    # contents of one nation are stored under other digests
    blobs = D.table(s, d, "customer").select(
        X.digest_of(F.concat(F.when(F.col("c_nationkey") == 3, "elsewhere ").otherwise(""), text)).alias("hash"), F.when(F.col("c_acctbal") > 0, text).otherwise(F.col("c_name")).alias("content")
    )
    return T.verify_tree(D.tree_nodes(s, d), blobs)


def _level(source: str, level: int) -> str:
    """SQL for the directory digests over the entries in ``source`` (parent, name, kind, flag, hash, files)."""
    return (
        f"SELECT parent AS path, sha256(string_agg(g, chr(10) ORDER BY spread)) AS dir_hash, CAST(sum(files) AS BIGINT) AS files, "
        f"CAST(sum(n) AS BIGINT) AS children, {level} AS level FROM (SELECT parent, substr(sha256(name), 1, 4) AS spread, "
        "sha256(string_agg(kind || '|' || flag || '|' || hash || '|' || name, chr(10) ORDER BY name)) AS g, sum(files) AS files, "
        f"count(*) AS n FROM {source} GROUP BY 1, 2) GROUP BY parent"
    )


@query(
    "build_tree",
    tree_sql(
        "SELECT sha256('world') AS root, * FROM (SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0)",
        leaves="SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS parent, string_split(path, '/')[3] AS name, "
        "'file' AS kind, CAST(CAST(is_executable AS INTEGER) AS VARCHAR) AS flag, hash, 1 AS files FROM flat WHERE root = sha256('world')",
        l2=_level("leaves", 2),
        e1="SELECT string_split(path, '/')[1] AS parent, string_split(path, '/')[2] AS name, 'dir' AS kind, '0' AS flag, dir_hash AS "
        "hash, files FROM l2",
        l1=_level("e1", 1),
        e0="SELECT '' AS parent, path AS name, 'dir' AS kind, '0' AS flag, dir_hash AS hash, files FROM l1",
        l0=_level("e0", 0),
    ),
)
def _(s, d):
    world = D.table(s, d, "region").select(X.digest_of(F.lit("world")).alias("dir_hash")).distinct()
    return T.build_tree(T.flatten_tree(D.tree_nodes(s, d), world))


OUTPUTS = (
    "SELECT conv_id AS action_id, sha256(text) AS hash, strlen(text) AS size_bytes, role = 'system' AS dir, length(text) % 17 = 0 AS "
    "bad FROM conversations"
)


def outputs(s, d):
    c = D.table(s, d, "conversations")
    return c.select(
        F.col("conv_id").alias("action_id"),
        X.digest_of(F.col("text")).alias("hash"),
        X.byte_size(F.col("text")).alias("size_bytes"),
        (F.col("role") == "system").alias("is_directory"),
        F.when(F.length("text") % 17 == 0, "unreadable").alias("error"),
    )


def stored_outputs(s, d):
    """One turn in three is stored as it is, the others with a word before them."""
    c = D.table(s, d, "conversations")
    return c.select(X.digest_of(F.when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("other "), "text"))).alias("hash"))


def upload_sql(skipped: str) -> str:
    return (
        f"SELECT action_id, count(*) FILTER (WHERE NOT bad AND NOT dir) AS files, count(*) FILTER (WHERE NOT bad AND dir) AS "
        f"directories, count(*) FILTER (WHERE NOT bad AND NOT dir AND {skipped}) AS cached_files, CAST(coalesce(sum(size_bytes) FILTER "
        f"(WHERE NOT bad AND NOT dir AND NOT ({skipped})), 0) AS BIGINT) AS bytes_uploaded, count(*) FILTER (WHERE bad) AS errors FROM "
        f"({OUTPUTS}) GROUP BY action_id"
    )


@query("upload_stats", upload_sql("hash IN (SELECT sha256(CASE WHEN turn % 3 = 1 THEN '' ELSE 'other ' END || text) FROM conversations)"))
def _(s, d):
    return T.upload_stats(outputs(s, d), stored_outputs(s, d))


@query("upload_stats_compat", upload_sql("size_bytes = 0"))
def _(s, d):
    return T.upload_stats(outputs(s, d), stored_outputs(s, d), compat=True)
