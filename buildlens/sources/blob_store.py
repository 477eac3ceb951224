"""A content store as bucketed tables.

Blobs are one row per digest, partitioned by the first characters of the digest and bucketed by the whole digest, so
that lookups meet the store without an exchange on its side, and deletions rewrite only the partitions they touch.
Contents are one row per (digest, chunk), bucketed by both: a range of a blob reads the chunks it covers, and the
chunks of a blob that everybody asks for lie in many buckets.

The tables live in a database below the shared folder. Rows with a null digest are no blobs and are not written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions import exprs as X
from buildlens.operators import store as B
from buildlens.session import checkpointed, shared_dir

DATABASE = "buildlens_store"
#: Defaults: bytes of a chunk, buckets, characters of the digest that make a partition (16 partitions for each).
CHUNK_BYTES, BUCKETS, PREFIX_CHARS = 1 << 20, 8, 1


def _new_table(spark: SparkSession, kind: str) -> str:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{shared_dir(spark)}/{DATABASE}'")
    return f"{DATABASE}.{kind}_{uuid.uuid4().hex}"


def write_blobs(blobs: DataFrame, name: str | None = None, buckets: int = BUCKETS, prefix_chars: int = PREFIX_CHARS) -> str:
    """Write one row per digest (any of equal ones) and name the table. ``buckets`` should follow the store's size."""
    name = name or _new_table(blobs.sparkSession, "blobs")
    # one exchange for the duplicates and the buckets, so each bucket of a partition is one file
    rows = blobs.filter(F.col("hash").isNotNull()).repartition(buckets, "hash").dropDuplicates(["hash"])
    rows = rows.withColumn("prefix", F.substring("hash", 1, prefix_chars))
    rows.write.partitionBy("prefix").bucketBy(buckets, "hash").sortBy("hash").saveAsTable(name)
    return name


def missing_in(requests: DataFrame, store: DataFrame) -> DataFrame:
    """``find_missing_blobs`` over a bucketed store: asked sizes are combined per digest, then meet the store by digest."""
    asked = requests.groupBy("hash").agg(F.min("size_bytes").alias("least"), F.max("size_bytes").alias("most"), F.count_if(F.col("size_bytes").isNull()).alias("unsized"))
    held = store.select("hash", F.col("size_bytes").alias("held"))
    wrong = F.col("held").isNull() | (F.col("least") != F.col("held")) | (F.col("most") != F.col("held")) | (F.col("unsized") > 0)
    missing = asked.join(held, "hash", "left").filter(wrong).select("hash")
    return requests.join(missing, F.equal_null(requests["hash"], missing["hash"]), "left_semi")


def delete_in(spark: SparkSession, name: str, listed: DataFrame) -> list[str]:
    """Delete the listed digests from the table; returns the prefixes of the partitions that changed.

    Unknown digests are no error and touch nothing. Partitions that keep rows are rewritten, emptied ones dropped. A
    repeated call finds nothing left to delete, so a run that was broken off is finished by running it again.
    """
    store = spark.table(name)
    gone = listed.filter(F.col("hash").isNotNull()).select("hash").distinct()
    # one row for each partition: their number is fixed by the length of the prefix
    counts = (
        store.select("hash", "prefix").join(gone.withColumn("gone", F.lit(1)), "hash", "left").groupBy("prefix")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("gone").alias("gone")).filter("gone > 0").collect()
    )
    kept = [r["prefix"] for r in counts if r["gone"] < r["rows"]]
    emptied = [r["prefix"] for r in counts if r["gone"] == r["rows"]]
    if kept:
        mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            rest = store.filter(F.col("prefix").isin(kept)).join(gone, "hash", "left_anti").select(*store.columns)
            rest.write.insertInto(name, overwrite=True)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    for prefix in emptied:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (prefix = '{prefix}')")
    spark.catalog.refreshTable(name)
    return sorted(kept + emptied)


def retain_in(spark: SparkSession, name: str, limit: int, order: str = "last_access") -> list[str]:
    """Evict the oldest blobs until the store fits ``limit``; returns the prefixes of the partitions that changed."""
    # the plan is cut from the table, as it is read again after partitions were rewritten
    victims = B.eviction_plan(spark.table(name).drop("prefix"), limit, order).select("hash")
    return delete_in(spark, name, checkpointed(victims))


def chunks_of(contents: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(hash, chunk, size_bytes, piece) of contents; an empty one has one empty chunk, a null one none."""
    content = F.col("content").cast("binary")
    size = X.byte_size(content)
    last = F.floor(F.greatest(size - 1, F.lit(0)) / chunk_bytes)
    each = contents.select("hash", content.alias("content"), size.alias("size_bytes"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    begin = (F.col("chunk") * chunk_bytes + 1).cast("int")
    return each.select("hash", "chunk", "size_bytes", F.substring("content", begin, F.lit(chunk_bytes)).alias("piece"))


def write_chunks(contents: DataFrame, chunk_bytes: int = CHUNK_BYTES, buckets: int = BUCKETS) -> str:
    """Write the chunks of (hash, content), one row per digest, and name the table."""
    name = _new_table(contents.sparkSession, "chunks")
    rows = chunks_of(contents.filter(F.col("hash").isNotNull()), chunk_bytes)
    rows.repartition(buckets, "hash", "chunk").write.bucketBy(buckets, "hash", "chunk").sortBy("hash", "chunk").saveAsTable(name)
    return name


def _end(offset: Column, limit: Column, size: Column) -> Column:
    return F.when(limit == 0, size).otherwise(F.least(offset + limit, size))


def range_in(requests: DataFrame, blobs: DataFrame, chunks: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``range_read`` over chunks: (request_id, hash, slice, bytes). An offset past the end gives nothing, limit 0 the rest.

    Requests learn the size from ``blobs`` (hash, size_bytes), become one row per covered chunk and meet ``chunks`` by
    digest and number. Equal requests are answered once.
    """
    key = ["request_id", "hash", "offset", "limit"]
    sized = requests.select(*key).distinct().join(blobs.select("hash", "size_bytes"), "hash")
    spans = sized.withColumn("end", _end(F.col("offset"), F.col("limit"), F.col("size_bytes")))
    covered = F.sequence(F.floor(F.col("offset") / chunk_bytes), F.floor((F.col("end") - 1) / chunk_bytes))
    wanted = spans.select(*key, "end", F.explode_outer(F.when(F.col("end") > F.col("offset"), covered)).alias("chunk"))
    met = wanted.join(chunks.select("hash", "chunk", "piece"), ["hash", "chunk"], "left")
    # where the request begins and ends within the chunk
    skip = F.greatest(F.col("offset") - F.col("chunk") * chunk_bytes, F.lit(0)).cast("int")
    upto = F.least(F.col("end") - F.col("chunk") * chunk_bytes, F.lit(chunk_bytes)).cast("int")
    part = F.hex(F.substring("piece", skip + 1, upto - skip))
    pieces = F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("chunk", part.alias("part")))))
    whole = met.groupBy(*key).agg(pieces.alias("pieces"))
    slice_ = F.unhex(F.array_join(F.transform("pieces", lambda p: p["part"]), ""))
    return whole.select("request_id", "hash", slice_.alias("slice")).withColumn("bytes", F.octet_length("slice").cast("bigint"))
