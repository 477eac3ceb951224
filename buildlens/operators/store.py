"""Content store over tables: digests, lookups, writes, integrity, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions import exprs as X
from buildlens.plans import ranks as R

# Default sizes in bytes.
MAX_CAPTURE = 100 * 1024 * 1024
INLINE_LIMIT = 1024 * 1024
STREAMING_LIMIT = 4 * 1024 * 1024


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def blob_digest(contents: DataFrame, content: str = "content") -> DataFrame:
    """Digest and byte length of each content; the content itself goes no further."""
    rest = [c for c in contents.columns if c != content]
    return contents.select(
        *rest, X.digest_of(F.col(content)).alias("hash"), X.byte_size(F.col(content)).alias("size_bytes")
    )


def digest_audit(rendered: DataFrame, by: str) -> DataFrame:
    """Valid, canonical and malformed digests per source; ``rendered`` may carry a ``-size`` suffix."""
    h, size = X.split_digest(F.col("digest"))
    raw = F.coalesce(F.when(size.isNotNull(), h), F.col("digest"))
    canon = X.canonical_digest(raw)
    return (
        rendered.select(by, raw.alias("raw"), canon.alias("canon"), size.alias("size"))
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("digests"),
            _count(F.col("canon").isNotNull()).alias("valid"),
            _count(F.col("canon") == F.col("raw")).alias("canonical"),
            _count(F.col("canon").isNull()).alias("malformed"),
            F.coalesce(F.sum(F.when(F.col("canon").isNotNull(), F.col("size"))), F.lit(0)).alias("sized_bytes"),
        )
    )


def dedup_blobs(blobs: DataFrame) -> DataFrame:
    """One row per digest with its copies and the bytes that storing it once saves."""
    return (
        blobs.groupBy("hash")
        .agg(F.first("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("copies"))
        .withColumn("bytes_saved", (F.col("copies") - 1) * F.col("size_bytes"))
    )


def dedup_ratio(blobs: DataFrame) -> DataFrame:
    d = dedup_blobs(blobs)
    return d.agg(
        F.sum("copies").alias("blobs"),
        F.count(F.lit(1)).alias("distinct_blobs"),
        F.sum("bytes_saved").alias("bytes_saved"),
        (F.lit(1.0) - F.count(F.lit(1)) / F.sum("copies")).alias("duplicate_ratio"),
    )


def find_missing_blobs(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests whose digest is not stored with that size.

    Requests are reduced to distinct digests before they meet the store, so a digest asked for by a third of all
    rows costs one probe. Rows map back by hash alone: a request with the right size still counts as missing when
    another request names the same hash with a wrong size.
    """
    asked = requests.select("hash", "size_bytes").distinct()
    missing = asked.join(store, ["hash", "size_bytes"], "left_anti").select("hash").distinct()
    return requests.join(missing, "hash", "left_semi")


def batch_read(requests: DataFrame, store: DataFrame, payload: list[str]) -> DataFrame:
    """Every request with its blob and status 0, or status 5 when there is none; in request order."""
    have = store.select("hash", F.col("size_bytes").alias("stored_size"), *payload)
    asked = requests.select("request_id", "hash")
    out = asked.join(have, "hash", "left")
    return out.withColumn("status", F.when(F.col("stored_size").isNotNull(), 0).otherwise(5)).orderBy("request_id")


def batch_write(uploads: DataFrame, store: DataFrame) -> DataFrame:
    """Verify, deduplicate and skip what exists: per upload a status (0 ok, 3 digest mismatch) and ``stored``.

    Digests are computed where the contents lie; only (id, digest) pairs are shuffled.
    """
    checked = uploads.select(
        "request_id",
        "hash",
        ((X.digest_of(F.col("content")) == F.col("hash")) & (X.byte_size(F.col("content")) == F.col("size_bytes"))).alias("ok"),
    )
    first = checked.filter("ok").groupBy("hash").agg(F.min("request_id").alias("request_id"))
    fresh = first.join(store.select("hash"), "hash", "left_anti").select("request_id", F.lit(True).alias("stored"))
    return checked.join(fresh, "request_id", "left").select(
        "request_id", "hash", F.when(F.col("ok"), 0).otherwise(3).alias("status"), F.coalesce("stored", F.lit(False)).alias("stored")
    )


def oversize_reject(blobs: DataFrame, limit: int) -> DataFrame:
    """Mark blobs larger than the limit; 0 means no limit."""
    return blobs.withColumn("accepted", F.lit(True) if limit == 0 else F.col("size_bytes") <= F.lit(limit))


def upload_overrun(chunks: DataFrame, declared: DataFrame) -> DataFrame:
    """Resources that received more than twice their declared size."""
    got = chunks.groupBy("resource").agg(F.sum("chunk_bytes").alias("received"))
    return got.join(declared, "resource").filter(F.col("received") > 2 * F.col("declared_size"))


def upload_status(resources: DataFrame, store: DataFrame) -> DataFrame:
    have = store.select("hash", F.col("size_bytes").alias("committed"))
    return resources.join(have, "hash", "left").select(
        *resources.columns,
        F.coalesce("committed", F.lit(0)).alias("committed_size"),
        F.col("committed").isNotNull().alias("complete"),
    )


def layout_profile(blobs: DataFrame) -> DataFrame:
    """Blobs and bytes below each of the two directory levels that spread the store."""
    return blobs.groupBy(F.substring("hash", 1, 2).alias("level1"), F.substring("hash", 3, 2).alias("level2")).agg(
        F.count(F.lit(1)).alias("blobs"), F.sum("size_bytes").alias("bytes")
    )


def resource_traffic(log: DataFrame) -> DataFrame:
    """Requests and bytes per digest; names that cannot be read are kept apart, one row per name."""
    digest, size = X.resource_parts(F.col("resource"))
    parsed = log.select(digest.alias("hash"), size.alias("size_bytes"), F.when(size.isNull(), F.col("resource")).alias("unread"))
    return parsed.groupBy("hash", "size_bytes", "unread").agg(
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    )


def transfer_mix(blobs: DataFrame, limit: int = STREAMING_LIMIT) -> DataFrame:
    """Blobs and bytes that move batched or streamed."""
    mode = F.when(F.col("size_bytes") > limit, "streamed").otherwise("batched")
    return blobs.groupBy(mode.alias("mode")).agg(F.count(F.lit(1)).alias("blobs"), F.sum("size_bytes").alias("bytes"))


def place_outputs(outputs: DataFrame, max_capture: int = MAX_CAPTURE, inline_limit: int = INLINE_LIMIT) -> DataFrame:
    """Where each captured output goes, how many bytes are kept, and the digest of what is stored."""
    size = X.byte_size(F.col("content"))
    truncated = size > max_capture
    kept = F.when(truncated, F.substring(F.col("content").cast("binary"), 1, max_capture)).otherwise(
        F.col("content").cast("binary")
    )
    placement = (
        F.when(size == 0, "inline").when(truncated, "truncated").when(size < inline_limit, "inline").otherwise("stored")
    )
    rest = [c for c in outputs.columns if c != "content"]
    return outputs.select(
        *rest,
        placement.alias("placement"),
        size.alias("size_bytes"),
        F.least(size, F.lit(max_capture)).cast("bigint").alias("kept_bytes"),
        F.when(placement != "inline", F.sha2(kept, 256)).alias("hash"),
    )


def output_placement(outputs: DataFrame, **limits) -> DataFrame:
    return place_outputs(outputs, **limits).groupBy("placement").agg(
        F.count(F.lit(1)).alias("outputs"), F.sum("size_bytes").alias("bytes"), F.sum("kept_bytes").alias("kept_bytes"),
        F.count_distinct("hash").alias("distinct_stored"),
    )


def range_read(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Slices of blobs: offset past the end gives nothing, limit 0 means the rest."""
    out = requests.join(store.select("hash", "content"), "hash")
    content = F.col("content").cast("binary")
    size = F.octet_length(content)
    rest = F.greatest(size - F.col("offset"), F.lit(0))
    n = F.when(F.col("limit") == 0, rest).otherwise(F.least(F.col("limit"), rest)).cast("int")
    piece = F.substring(content, (F.col("offset") + 1).cast("int"), n)
    return out.select("request_id", "hash", F.when(n > 0, piece).otherwise(F.lit(b"")).alias("slice"), n.cast("bigint").alias("bytes"))


def store_size(blobs: DataFrame) -> DataFrame:
    return dedup_blobs(blobs).agg(F.count(F.lit(1)).alias("blobs"), F.sum("size_bytes").alias("bytes"))


def verify_blobs(blobs: DataFrame) -> DataFrame:
    """Blobs whose content no longer has the recorded digest or size. A map-only pass over the contents."""
    digest, size = X.digest_of(F.col("content")), X.byte_size(F.col("content"))
    rest = [c for c in blobs.columns if c != "content"]
    bad_hash, bad_size = digest != F.col("hash"), size != F.col("size_bytes")
    return blobs.filter(bad_hash | bad_size).select(*rest, bad_hash.alias("bad_hash"), bad_size.alias("bad_size"))


def eviction_plan(blobs: DataFrame, limit: int, order: str = "last_access") -> DataFrame:
    """Victims, oldest access first, until the store fits ``limit``: a row goes iff the bytes before it are fewer
    than must be freed. No sort of the store: see ``ranks.prefix_rows``."""
    total = blobs.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("t")).first()["t"]
    return R.prefix_rows(blobs, order, "size_bytes", int(total) - limit, "hash")


def entry_cap_eviction(entries: DataFrame, capacity: int, policy: str = "fifo") -> DataFrame:
    """Entries to drop so that the newest ``capacity`` stay, by insertion (``fifo``) or by last access (``lru``)."""
    order = {"fifo": "inserted_us", "lru": "accessed_us"}[policy]
    weighted = entries.withColumn("_one", F.lit(1).cast("bigint"))
    surplus = entries.count() - capacity
    return R.prefix_rows(weighted, order, "_one", surplus, "hash").drop("_one")


def expired_entries(entries: DataFrame, now_us: int, ttl_seconds: int) -> DataFrame:
    """Entries older than the time to live; an age equal to it is still valid."""
    return entries.filter(F.lit(now_us) - F.col("inserted_us") > F.lit(ttl_seconds * 1_000_000))


def delete_blobs(store: DataFrame, listed: DataFrame) -> DataFrame:
    """What remains after deleting the listed digests; unknown ones are no error."""
    return store.join(listed.select("hash").distinct(), "hash", "left_anti")


def validate_references(results: DataFrame, blobs: DataFrame) -> DataFrame:
    """Cached results that name an output the store no longer has, with the number of outputs missing."""
    named = results.select("action_hash", F.explode("outputs").alias("hash")).distinct()
    gone = named.join(blobs.select("hash"), "hash", "left_anti")
    return gone.groupBy("action_hash").agg(F.count(F.lit(1)).alias("missing_outputs"))
