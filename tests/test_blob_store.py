"""The store as bucketed tables: plans without an exchange over it, partitions that deletions touch, ranges over chunks."""

import os
import re

import pytest
from pyspark.sql import functions as F

from buildlens.operators import store as S
from buildlens.sources import blob_store as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def blobs(spark, n):
    return spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), (F.col("id") + 1).alias("size_bytes"), F.col("id").alias("last_access"))


def exchanges_over(df, table):
    """Exchanges between the scan of the table and the join above it."""
    lines = plan(df).splitlines()
    at = next(i for i, line in enumerate(lines) if "Scan parquet" in line and table in line.replace("`", ""))
    depth = [len(re.match(r"[\s:|+\-*()\d]*", line).group()) for line in lines]
    above, level = [], depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < level:
            level = depth[i]
            if "Join" in lines[i]:
                break
            above.append(lines[i])
    return [line for line in above if "Exchange" in line]


def test_lookups_do_not_move_the_store(spark, no_broadcast):
    name = T.write_blobs(blobs(spark, 400))
    store = spark.table(name)
    asked = blobs(spark, 600).select(F.col("last_access").alias("request_id"), "hash", "size_bytes")
    for df in (T.missing_in(asked, store), S.batch_read(asked, store, [])):
        assert "Bucketed: true" in df._jdf.queryExecution().toString()
        assert exchanges_over(df, name) == []
    assert T.missing_in(asked, store).count() == 200


def test_missing_as_the_plain_operator(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "hash string, size_bytes bigint")
    asked = spark.createDataFrame([(1, "a", 1), (2, "a", 9), (3, "b", 2), (4, "d", 4), (5, "c", None), (6, None, 6), (7, None, None), (8, "b", 2)], "request_id int, hash string, size_bytes bigint")
    got = {r.request_id for r in T.missing_in(asked, spark.table(T.write_blobs(store))).collect()}
    assert got == {1, 2, 4, 5, 6, 7}


def test_deletion_rewrites_touched_partitions_only(spark):
    rows = blobs(spark, 300)
    name = T.write_blobs(rows)
    location = next(r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect() if r.col_name == "Location").replace("file:", "")

    def files():
        return {os.path.join(at, f) for at, _, names in os.walk(location) for f in names if f.startswith("part-")}

    before = files()
    one = rows.filter(F.substring("hash", 1, 1) == "3").limit(1).select("hash").collect()[0].hash
    listed = spark.createDataFrame([(one,), (one,), ("3unknown",), ("zz",), (None,)], "hash string")
    assert T.delete_in(spark, name, listed) == ["3"]
    changed = before ^ files()
    assert changed and all("/prefix=3/" in f for f in changed)
    assert spark.table(name).count() == 299
    assert T.delete_in(spark, name, listed) == []
    # a partition that loses all its rows is dropped
    every = rows.filter(F.substring("hash", 1, 1) == "a").select("hash")
    assert T.delete_in(spark, name, every) == ["a"]
    assert not any("/prefix=a/" in f for f in files())
    left = {r.hash for r in spark.table(name).collect()}
    assert left == {r.hash for r in rows.collect() if r.hash != one and r.hash[0] != "a"}


def test_retention_keeps_the_newest(spark):
    name = T.write_blobs(blobs(spark, 100))
    T.retain_in(spark, name, 1000)
    left = sorted(r.last_access for r in spark.table(name).collect())
    assert left == list(range(100 - len(left), 100)) and sum(x + 1 for x in left) <= 1000 < sum(x + 1 for x in left) + left[0]
    assert T.retain_in(spark, name, 1000) == []
    none = T.write_blobs(blobs(spark, 0))
    assert T.retain_in(spark, none, 10) == [] and spark.table(none).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 4, 100])
def test_ranges_over_chunks(spark, chunk):
    contents = {"h": b"abcdefghij", "e": b"", "x": bytes(range(256))}
    store = spark.createDataFrame([*contents.items(), (None, b"zz"), ("n", None)], "hash string, content binary")
    chunks = spark.table(T.write_chunks(store, chunk))
    asked = [(i, h, o, n) for i, (h, o, n) in enumerate((h, o, n) for h in contents for o in (0, 1, 3, 4, 9, 10, 99) for n in (0, 1, 4, 7, 500))]
    requests = spark.createDataFrame([*asked, asked[0], (-1, "unknown", 0, 0)], "request_id int, hash string, offset bigint, limit bigint")
    sizes = chunks.filter("chunk = 0").select("hash", "size_bytes")
    got = {r.request_id: (bytes(r.slice), r.bytes) for r in T.range_in(requests, sizes, chunks, chunk).collect()}
    want = {i: contents[h][o : o + n if n else None] for i, h, o, n in asked}
    assert got == {i: (b, len(b)) for i, b in want.items()}


def test_ranges_do_not_move_the_chunks(spark, no_broadcast):
    store = blobs(spark, 50).select("hash", F.col("hash").alias("content"))
    name = T.write_chunks(store, 16)
    chunks = spark.table(name)
    requests = store.select(F.monotonically_increasing_id().alias("request_id"), "hash", F.lit(10).cast("bigint").alias("offset"), F.lit(20).cast("bigint").alias("limit"))
    sizes = spark.table(T.write_blobs(blobs(spark, 50).withColumn("size_bytes", F.lit(64).cast("bigint"))))
    df = T.range_in(requests, sizes, chunks, 16)
    assert exchanges_over(df, name) == []
    assert all(bytes(r.slice).decode() == r.hash[10:30] for r in df.collect())
