"""Registered queries for the content store and the action cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlens.catalog.sqltext import with_ctes
from buildlens.functions import exprs as X
from buildlens.operators import cache as C
from buildlens.operators import store as B
from buildlens.plans import standins as D
from buildlens.session import checkpointed, scratch_path
from buildlens.sources import blob_store as T
from buildlens.sources import inventory as I

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("blob_digest", "SELECT doc_id, sha256(text) AS hash, strlen(text) AS size_bytes FROM documents")
def _(s, d):
    return B.blob_digest(D.table(s, d, "documents").select("doc_id", F.col("text").alias("content")))


@query(
    "digest_audit",
    with_ctes(
        "docs",
        "SELECT source, count(*) AS digests, count(*) FILTER (WHERE lang <> 'de') AS valid, "
        "count(*) FILTER (WHERE lang NOT IN ('de', 'en')) AS canonical, count(*) FILTER (WHERE lang = 'de') AS malformed, "
        "CAST(coalesce(sum(size_bytes) FILTER (WHERE lang NOT IN ('de', 'en', 'fr')), 0) AS BIGINT) AS sized_bytes "
        "FROM docs GROUP BY source",
    ),
)
def _(s, d):
    lang = F.col("lang")
    digest = (
        F.when(lang == "en", F.regexp_replace(F.upper("hash"), "^[0-9]", "A"))
        .when(lang == "fr", F.col("hash"))
        .when(lang == "de", F.substring("hash", 1, 63))
        .otherwise(F.concat("hash", F.lit("-"), F.col("size_bytes").cast("string")))
    )
    return B.digest_audit(D.documents(s, d).select("source", digest.alias("digest")), "source")


@query(
    "dedup_blobs",
    with_ctes("docs", "SELECT hash, size_bytes, count(*) AS copies, (count(*) - 1) * size_bytes AS bytes_saved FROM docs "
              "GROUP BY hash, size_bytes"),
)
def _(s, d):
    return B.dedup_blobs(D.documents(s, d).select("hash", "size_bytes"))


@query(
    "dedup_ratio",
    with_ctes("docs", "SELECT count(*) AS blobs, count(DISTINCT hash) AS distinct_blobs, CAST((SELECT sum(saved) FROM "
              "(SELECT (count(*) - 1) * size_bytes AS saved FROM docs GROUP BY hash, size_bytes)) AS BIGINT) AS bytes_saved, "
              "1.0::DOUBLE - count(DISTINCT hash)::DOUBLE / count(*) AS duplicate_ratio FROM docs"),
)
def _(s, d):
    return B.dedup_ratio(D.documents(s, d).select("hash", "size_bytes"))


@query(
    "find_missing_blobs",
    with_ctes("req store", "SELECT request_id, hash, size_bytes FROM req r WHERE NOT EXISTS (SELECT 1 FROM store t "
              "WHERE t.hash = r.hash AND t.size_bytes = r.size_bytes)"),
)
def _(s, d):
    return B.find_missing_blobs(D.requested_digests(s, d), D.stored_digests(s, d))


@query(
    "batch_read",
    with_ctes("req store", "SELECT request_id, r.hash, t.size_bytes AS stored_size, first_doc, "
              "CASE WHEN t.hash IS NULL THEN 5 ELSE 0 END AS status FROM req r LEFT JOIN store t ON t.hash = r.hash "
              "ORDER BY request_id"),
)
def _(s, d):
    return B.batch_read(D.requested_digests(s, d), D.stored_digests(s, d), ["first_doc"])


@query(
    "batch_write",
    with_ctes(
        "docs",
        "SELECT request_id, hash, CASE WHEN ok THEN 0 ELSE 3 END AS status, ok AND NOT had AND "
        "coalesce(request_id = min(request_id) FILTER (WHERE ok) OVER (PARTITION BY hash), false) AS stored FROM (SELECT "
        "doc_id AS request_id, CASE WHEN toxic = 1 THEN sha256(text || 'x') ELSE hash END AS hash, "
        "coalesce(toxic, 0) = 0 AS ok, hash IN (SELECT d.hash FROM docs d JOIN labels q USING (doc_id) WHERE q.quality = 0) "
        "AS had FROM docs LEFT JOIN labels USING (doc_id))",
    ),
)
def _(s, d):
    docs, labels = D.table(s, d, "documents"), D.table(s, d, "labels")
    claimed = F.when(F.col("toxic") == 1, X.digest_of(F.concat("text", F.lit("x")))).otherwise(X.digest_of(F.col("text")))
    uploads = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("request_id"), claimed.alias("hash"), X.byte_size(F.col("text")).alias("size_bytes"),
        F.col("text").alias("content"),
    )
    store = D.documents(s, d).select("doc_id", "hash").join(labels.filter("quality = 0"), "doc_id").select("hash").distinct()
    return B.batch_write(uploads, store)


@query("oversize_reject", with_ctes("docs", "SELECT doc_id, hash, size_bytes, size_bytes <= 4096 AS accepted FROM docs"))
def _(s, d):
    return B.oversize_reject(D.documents(s, d).select("doc_id", "hash", "size_bytes"), 4096)


@query(
    "upload_overrun",
    "SELECT conv_id AS resource, CAST(sum(strlen(text)) AS BIGINT) AS received, "
    "max(strlen(text)) FILTER (WHERE turn = 0) AS declared_size FROM conversations GROUP BY conv_id "
    "HAVING sum(strlen(text)) > 2 * max(strlen(text)) FILTER (WHERE turn = 0)",
)
def _(s, d):
    c = D.table(s, d, "conversations").select(
        F.col("conv_id").alias("resource"), "turn", X.byte_size(F.col("text")).alias("chunk_bytes")
    )
    declared = c.filter("turn = 0").groupBy("resource").agg(F.max("chunk_bytes").alias("declared_size"))
    return B.upload_overrun(c, declared)


@query(
    "upload_status",
    with_ctes("req store", "SELECT request_id, r.hash, coalesce(t.size_bytes, 0) AS committed_size, t.hash IS NOT NULL "
              "AS complete FROM req r LEFT JOIN store t ON t.hash = r.hash"),
)
def _(s, d):
    return B.upload_status(D.requested_digests(s, d).select("request_id", "hash"), D.stored_digests(s, d))


@query(
    "layout_profile",
    with_ctes("docs", "SELECT substr(hash, 1, 2) AS level1, substr(hash, 3, 2) AS level2, count(*) AS blobs, "
              "CAST(sum(size_bytes) AS BIGINT) AS bytes FROM docs GROUP BY 1, 2"),
)
def _(s, d):
    return B.layout_profile(D.documents(s, d))


@query(
    "resource_traffic",
    with_ctes(
        "docs",
        "SELECT CASE WHEN size IS NOT NULL THEN p[-2] END AS hash, size AS size_bytes, CASE WHEN size IS NULL THEN resource END "
        "AS unread, count(*) AS requests, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT resource, p, "
        "CASE WHEN regexp_full_match(p[-1], '[+-]?[0-9]+') THEN CAST(p[-1] AS BIGINT) END AS size FROM (SELECT resource, "
        "string_split(resource, '/') AS p FROM log)) GROUP BY ALL",
        log="SELECT 'uploads/' || doc_id || '/blobs/' || hash || '/' || size_bytes AS resource FROM docs "
        "UNION ALL SELECT url FROM pages",
    ),
)
def _(s, d):
    docs = D.documents(s, d)
    name = F.concat(
        F.lit("uploads/"), F.col("doc_id").cast("string"), F.lit("/blobs/"), "hash", F.lit("/"), F.col("size_bytes").cast("string")
    )
    log = docs.select(name.alias("resource")).unionByName(D.table(s, d, "pages").select(F.col("url").alias("resource")))
    return B.resource_traffic(log)


@query(
    "transfer_mix",
    with_ctes("docs", "SELECT CASE WHEN size_bytes > 2048 THEN 'streamed' ELSE 'batched' END AS mode, count(*) AS blobs, "
              "CAST(sum(size_bytes) AS BIGINT) AS bytes FROM docs GROUP BY 1"),
)
def _(s, d):
    return B.transfer_mix(D.documents(s, d), 2048)


@query(
    "output_placement",
    "SELECT placement, count(*) AS outputs, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(least(size, 8192)) AS BIGINT) "
    "AS kept_bytes, count(DISTINCT CASE WHEN placement <> 'inline' THEN substr(hex(encode(html)), 1, 16384) END) "
    "AS distinct_stored FROM (SELECT html, strlen(html) AS size, CASE WHEN strlen(html) = 0 THEN 'inline' "
    "WHEN strlen(html) > 8192 THEN 'truncated' WHEN strlen(html) < 2048 THEN 'inline' ELSE 'stored' END AS placement "
    "FROM pages) GROUP BY placement",
)
def _(s, d):
    pages = D.table(s, d, "pages").select("page_id", F.col("html").alias("content"))
    return B.output_placement(pages, max_capture=8192, inline_limit=2048)


@query(
    "range_read",
    with_ctes(
        "docs",
        "SELECT doc_id AS request_id, hash, upper(substr(hex(encode(text)), 2 * off + 1, 2 * n)) AS slice, n AS bytes "
        "FROM (SELECT *, CASE WHEN lim = 0 THEN greatest(size_bytes - off, 0) ELSE least(lim, greatest(size_bytes - off, 0)) "
        "END AS n FROM (SELECT *, doc_id % 3000 AS off, doc_id % 3 * 100 AS lim FROM docs))",
    ),
)
def _(s, d):
    docs = D.documents(s, d)
    requests = docs.select(
        F.col("doc_id").alias("request_id"),
        "hash",
        (F.col("doc_id") % 3000).alias("offset"),
        (F.col("doc_id") % 3 * 100).alias("limit"),
    )
    chunks = s.table(T.write_chunks(docs.groupBy("hash").agg(F.first("text").alias("content")), chunk_bytes=256))
    sizes = chunks.filter("chunk = 0").select("hash", "size_bytes")
    return T.range_in(requests, sizes, chunks, chunk_bytes=256).withColumn("slice", F.hex("slice"))


@query(
    "store_missing",
    with_ctes("req store", "SELECT request_id, hash, size_bytes FROM req r WHERE NOT EXISTS (SELECT 1 FROM store t "
              "WHERE t.hash = r.hash AND t.size_bytes = r.size_bytes)"),
)
def _(s, d):
    return T.missing_in(D.requested_digests(s, d), s.table(T.write_blobs(D.stored_digests(s, d))))


@query(
    "store_read",
    with_ctes("req store", "SELECT request_id, r.hash, t.size_bytes AS stored_size, first_doc, "
              "CASE WHEN t.hash IS NULL THEN 5 ELSE 0 END AS status FROM req r LEFT JOIN store t ON t.hash = r.hash "
              "ORDER BY request_id"),
)
def _(s, d):
    return B.batch_read(D.requested_digests(s, d), s.table(T.write_blobs(D.stored_digests(s, d))), ["first_doc"])


@query(
    "store_delete",
    with_ctes("docs store", "SELECT DISTINCT hash, size_bytes FROM docs WHERE hash NOT IN (SELECT hash FROM store)"),
)
def _(s, d):
    name = T.write_blobs(D.documents(s, d).select("hash", "size_bytes"))
    T.delete_in(s, name, D.stored_digests(s, d))
    return s.table(name).select("hash", "size_bytes")


@query(
    "store_size",
    with_ctes("docs", "SELECT count(*) AS blobs, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT hash, size_bytes "
              "FROM docs)"),
)
def _(s, d):
    return B.store_size(D.documents(s, d).select("hash", "size_bytes"))


@query(
    "verify_blobs",
    with_ctes(
        "docs",
        "SELECT doc_id, CASE WHEN lang = 'en' THEN sha256(source) ELSE hash END AS hash, n_chars AS size_bytes, "
        "lang = 'en' AS bad_hash, size_bytes <> n_chars AS bad_size FROM docs WHERE lang = 'en' OR size_bytes <> n_chars",
    ),
)
def _(s, d):
    docs = D.table(s, d, "documents")
    stored = F.when(F.col("lang") == "en", X.digest_of(F.col("source"))).otherwise(X.digest_of(F.col("text")))
    return B.verify_blobs(
        docs.select("doc_id", stored.alias("hash"), F.col("n_chars").alias("size_bytes"), F.col("text").alias("content"))
    )


# one blob per digest, accessed last when its newest copy arrived; coarse times make ties
BLOBS = (
    "SELECT hash, size_bytes, max(doc_id) // 7 AS last_access FROM docs GROUP BY hash, size_bytes"
)


def accessed_blobs(s, d):
    return D.documents(s, d).groupBy("hash", "size_bytes").agg(
        F.floor(F.max("doc_id") / 7).cast("bigint").alias("last_access")
    )


@query(
    "eviction_plan",
    with_ctes(
        "docs",
        "SELECT hash, size_bytes, last_access FROM (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY last_access, hash "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size_bytes) OVER () AS total FROM blobs) "
        "WHERE before < total - 500000",
        blobs=BLOBS,
    ),
)
def _(s, d):
    # the plan reads the inventory several times; a derived one is stored first
    return B.eviction_plan(checkpointed(accessed_blobs(s, d)), 500000)


@query(
    "store_retain",
    with_ctes(
        "docs",
        "SELECT hash, size_bytes, last_access FROM (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY last_access, hash "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size_bytes) OVER () AS total FROM blobs) "
        "WHERE before >= total - 500000",
        blobs=BLOBS,
    ),
)
def _(s, d):
    name = T.write_blobs(accessed_blobs(s, d))
    T.retain_in(s, name, 500000)
    return s.table(name).drop("prefix")


ENTRIES = (
    "SELECT sha256(user_id || '-' || k) AS hash, min(us) AS inserted_us, max(us) AS accessed_us FROM ev GROUP BY 1"
)


def entries(s, d):
    e = D.event_log(s, d)
    key = F.sha2(F.concat_ws("-", F.col("user_id").cast("string"), F.col("k").cast("string")).cast("binary"), 256)
    us = F.unix_micros("ts")
    return e.groupBy(key.alias("hash")).agg(F.min(us).alias("inserted_us"), F.max(us).alias("accessed_us"))


for _policy, _column in (("fifo", "inserted_us"), ("lru", "accessed_us")):

    def _cap(s, d, policy=_policy):
        return B.entry_cap_eviction(checkpointed(entries(s, d)), 300, policy)

    query(
        "entry_cap_eviction" if _policy == "fifo" else "entry_cap_eviction_lru",
        with_ctes(
            "ev",
            f"SELECT * FROM (SELECT hash, inserted_us, accessed_us FROM ent ORDER BY {_column} DESC, hash DESC OFFSET 300)",
            ent=ENTRIES,
        ),
    )(_cap)


@query(
    "expired_entries",
    with_ctes("ev", "SELECT * FROM ent WHERE (SELECT max(us) FROM ev) - inserted_us > 864000000000", ent=ENTRIES),
)
def _(s, d):
    now = D.event_log(s, d).agg(F.max(F.unix_micros("ts"))).first()[0]
    return B.expired_entries(entries(s, d), now, 10 * 86400)


@query(
    "delete_blobs",
    with_ctes("docs store", "SELECT DISTINCT hash, size_bytes FROM docs WHERE hash NOT IN (SELECT hash FROM store)"),
)
def _(s, d):
    held = D.documents(s, d).select("hash", "size_bytes").distinct()
    return B.delete_blobs(held, D.stored_digests(s, d))


@query(
    "validate_references",
    "WITH b AS (SELECT sha256(p_name) AS hash FROM part WHERE p_size > 25 UNION SELECT sha256(p_type) FROM part UNION "
    "SELECT sha256(p_brand) FROM part WHERE p_brand < 'Brand#2'), n AS (SELECT DISTINCT p_partkey AS action_hash, "
    "unnest([sha256(p_name || p_size), sha256(p_name), sha256(p_type), sha256(p_brand)][2:]) AS hash FROM part) "
    "SELECT action_hash, count(*) AS missing_outputs FROM n WHERE hash NOT IN (SELECT hash FROM b) GROUP BY action_hash",
)
def _(s, d):
    p = D.table(s, d, "part")
    sha = lambda c: X.digest_of(F.col(c))
    results = p.select(F.col("p_partkey").alias("action_hash"), F.array(sha("p_name"), sha("p_type"), sha("p_brand")).alias("outputs"))
    blobs = (
        p.filter("p_size > 25").select(sha("p_name").alias("hash"))
        .union(p.select(sha("p_type")))
        .union(p.filter("p_brand < 'Brand#2'").select(sha("p_brand")))
        .distinct()
    )
    return B.validate_references(results, blobs)


@query(
    "scan_blob_inventory",
    with_ctes("docs", "SELECT hash, size_bytes, doc_id AS modified FROM docs WHERE lang <> 'de'"),
)
def _(s, d):
    h = F.col("hash")
    nested = F.concat_ws("/", F.lit("/store"), F.substring(h, 1, 2), F.substring(h, 3, 2), h.substr(F.lit(5), F.lit(60)))
    path = (
        F.when(F.col("lang") == "de", F.concat(F.lit("/store/.tmp/"), h))
        .when(F.col("lang") == "en", F.concat(F.lit("/store/"), h))
        .otherwise(nested)
    )
    listing = D.documents(s, d).select(path.alias("path"), F.col("size_bytes").alias("length"), F.col("doc_id").alias("modified"))
    return I.digests_of_listing(listing, "/store").select("hash", F.col("length").alias("size_bytes"), "modified")


@query("list_blob_files", with_ctes("docs", "SELECT DISTINCT hash, size_bytes FROM docs"))
def _(s, d):
    root = scratch_path(s, "blob-files")
    I.write_blob_files(D.documents(s, d).groupBy("hash").agg(F.first("text").alias("content")), root)
    return I.scan_blob_inventory(s, root).select("hash", "size_bytes")


TTL = (
    "SELECT seq, k AS hash, us - put_us AS age_us, CASE WHEN put_us IS NULL THEN 'miss' WHEN us - put_us <= 3600000000 "
    "THEN 'hit' ELSE 'expired' END AS outcome FROM (SELECT *, max(CASE WHEN put THEN us END) OVER (PARTITION BY k ORDER BY us, "
    "NOT put, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS put_us FROM (SELECT *, event_type IN "
    "('purchase', 'signup') AS put FROM ev)) WHERE NOT put"
)


@query("cache_lookup_ttl", with_ctes("ev", TTL))
def _(s, d):
    return C.cache_lookup_ttl(D.cache_log(s, d), 3600)
