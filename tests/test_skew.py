"""The paths for keys that hold most rows must give what the plain paths give."""

import random

import pytest
from pyspark.sql import functions as F

from buildlens.operators import cache as C
from buildlens.operators import execution as E
from buildlens.operators import store as B
from buildlens.operators import workers as W
from buildlens.plans import ranks as R
from buildlens.plans import standins as D
from buildlens.plans.ordered import SLICE, carry, cut, following, previous


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    """1,500 rows of which one key holds a third, with ties in time and nulls."""
    rnd = random.Random(7)
    data = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}"
        data.append((key, rnd.randrange(4000), i, rnd.randrange(100) if rnd.random() < 0.7 else None))
    return spark.createDataFrame(data, "key string, at bigint, seq bigint, v bigint").cache()


def sizes(df, keys, order, limit):
    return [r["count"] for r in cut(df, keys, order, limit).groupBy(*keys, SLICE).count().collect()]


def test_small_keys_are_one_slice(hot):
    assert {r[SLICE] for r in cut(hot, ["key"], ["at", "seq"], 1000).select(SLICE).distinct().collect()} == {0}


@pytest.mark.parametrize("shape", ["burst", "instant", "even", "null key"])
def test_slices_are_balanced_by_rows(spark, shape):
    """300,000 rows of one key, all but a few within one second, or at one instant."""
    rows = spark.range(300_000).withColumn("key", F.when(F.lit(shape != "null key"), F.when(F.col("id") % 30 == 0, "other").otherwise("hot")))
    at = {"burst": F.when(F.col("id") < 10, F.col("id") * 10**9).otherwise(10**6 + F.col("id") % 1000), "instant": F.lit(5)}
    rows = rows.withColumn("at", at.get(shape, F.col("id"))).withColumnRenamed("id", "seq")
    found = sizes(rows, ["key"], ["at", "seq"], 10_000)
    assert sum(found) == 300_000 and max(found) <= 2 * 10_000
    got = carry(rows, ["key"], ["at", "seq"], total={"before": F.lit(1)}, max_rows=10_000)
    per = got.groupBy("key").agg(F.count_distinct("before").alias("n"), F.min("before").alias("lo"), F.max("before").alias("hi"), F.count(F.lit(1)).alias("rows"))
    assert all(r.n == r.rows and r.lo == 0 and r.hi == r.rows - 1 for r in per.collect())


@pytest.mark.parametrize("include_current", [False, True])
@pytest.mark.parametrize("descending", [False, True])
def test_carry_is_the_same_when_sliced(hot, include_current, descending):
    def run(limit):
        return carry(
            hot,
            ["key"],
            ["at", "seq"],
            last={"l": F.col("v")},
            total={"t": F.col("v")},
            peak={"p": F.col("v")},
            include_current=include_current,
            descending=descending,
            max_rows=limit,
        )

    plain = rows(run(10_000))
    assert plain == rows(run(50)) == rows(run(3))


def test_carry_against_a_loop(hot):
    got = {r.seq: (r.l, r.t, r.p) for r in carry(
        hot, ["key"], ["at", "seq"], last={"l": F.col("v")}, total={"t": F.col("v")}, peak={"p": F.col("v")},
        max_rows=37).collect()}
    state = {}
    for r in sorted(hot.collect(), key=lambda r: (r.key, r.at, r.seq)):
        last, total, peak = state.get(r.key, (None, 0, None))
        assert got[r.seq] == (last, total, peak)
        if r.v is not None:
            state[r.key] = (r.v, total + r.v, r.v if peak is None else max(peak, r.v))


def test_neighbours_when_sliced(hot):
    for f in (previous, following):
        assert rows(f(hot, ["key"], ["at", "seq"], {"n": "v", "s": "seq"})) == rows(
            f(hot, ["key"], ["at", "seq"], {"n": "v", "s": "seq"}, max_rows=20)
        )


@pytest.mark.parametrize(
    "name,run",
    [
        ("ttl", lambda s, d, o: C.cache_lookup_ttl(D.cache_log(s, d), 3600, **o)),
        ("durations", lambda s, d, o: E.stage_durations(D.transitions(s, d), **o)),
        ("audit", lambda s, d, o: E.transition_audit(D.transitions(s, d), **o)),
        ("streaks", lambda s, d, o: W.failure_streaks(D.connection_events(s, d), **o)),
        ("alerts", lambda s, d, o: W.health_alerts(D.connection_events(s, d), **o)),
        ("connections", lambda s, d, o: W.connection_metrics(D.connection_events(s, d), **o)),
        (
            "sojourn",
            lambda s, d, o: W.state_sojourn(
                D.worker_states(s, d).withColumn("state", W.state_name(F.col("state_code"))), **o
            ),
        ),
    ],
)
def test_operators_when_sliced(spark, sf_dir, name, run):
    assert rows(run(spark, sf_dir, {})) == rows(run(spark, sf_dir, {"max_rows": 4}))


def loop_merge(requests):
    flying, out = {}, {}
    for h, seq, at, done in sorted(requests, key=lambda r: (r[2], r[1])):
        if h in flying and flying[h][1] > at:
            out[seq] = flying[h][0]
        else:
            flying[h] = (seq, done)
            out[seq] = seq
    return out


@pytest.mark.parametrize("seed,length", [(1, 5), (2, 40), (3, 400)])
def test_merge_against_a_loop(spark, seed, length):
    rnd = random.Random(seed)
    data = []
    for i in range(900):
        at = rnd.randrange(3000)
        data.append(("hot" if i % 3 else f"h{rnd.randrange(5)}", i, at, at + rnd.randrange(length)))
    df = spark.createDataFrame(data, "hash string, seq bigint, enqueued_us bigint, completed_us bigint")
    want = loop_merge(data)
    for limit in (10_000, 30):
        got = {r.seq: r.merged_into for r in E.merge_inflight(df, limit).collect()}
        assert got == want


def test_nearest_rank_against_sorting(spark, hot):
    found = {(r.key, r.percentile): r.value for r in R.nearest_rank(hot, ["key"], "v", [0, 50, 95, 99, 100]).collect()}
    groups = {}
    for r in hot.collect():
        if r.v is not None:
            groups.setdefault(r.key, []).append(r.v)
    for key, values in groups.items():
        values.sort()
        for p in (0, 50, 95, 99, 100):
            assert found[key, p] == values[min(int(len(values) * p / 100), len(values) - 1)]


def test_nearest_rank_of_one_hundred_values(spark):
    df = spark.range(1, 101).select(F.lit("a").alias("g"), (F.col("id") * 1.5).alias("v"))
    assert R.nearest_rank(df, ["g"], "v", [95]).first().value == 96 * 1.5


def test_bands_are_monotone_for_any_sign(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1e300, -5.5, -1.0, -0.2, 0.0, 1e-9, 0.3, 2.0, 2.001, 7e9)], "v double")
    bands = [r.b for r in df.orderBy("v").select(R.band(F.col("v")).alias("b")).collect()]
    assert bands == sorted(bands)


@pytest.mark.parametrize("keep", [0, 1, 500, 4999, 5000, 10**9])
def test_eviction_against_a_loop(spark, keep):
    rnd = random.Random(3)
    data = [(f"{rnd.getrandbits(256):064x}", rnd.randrange(1, 60), rnd.choice([5, 5, 5, rnd.randrange(10**7)])) for _ in range(400)]
    df = spark.createDataFrame(data, "hash string, size_bytes bigint, last_access bigint")
    to_free, before, want = sum(d[1] for d in data) - keep, 0, []
    for h, size, _ in sorted(data, key=lambda d: (d[2], d[0])):
        if before < to_free:
            want.append(h)
        before += size
    assert sorted(r.hash for r in B.eviction_plan(df, keep).collect()) == sorted(want)


def test_find_missing_with_a_hot_digest(spark):
    asked = spark.createDataFrame(
        [(i, "a" if i % 3 else f"x{i}", 1) for i in range(30)], "request_id bigint, hash string, size_bytes bigint"
    )
    store = spark.createDataFrame([("x0", 1), ("x3", 2)], "hash string, size_bytes bigint")
    got = sorted(r.request_id for r in B.find_missing_blobs(asked, store).collect())
    assert got == [i for i in range(30) if i != 0]


def test_percentiles_of_null_groups_and_of_any_magnitude(spark):
    rnd = random.Random(11)
    for low, high in ((1e-5, 1.1e-5), (1e12, 1e12 + 5e4), (-3.0, 3.0)):
        values = [rnd.uniform(low, high) for _ in range(5000)] + [low, low, 0.0]
        df = spark.createDataFrame([(None if k % 2 else "a", v) for k, v in enumerate(values)], "op string, duration double")
        got = {(r.op, r.percentile): r.value for r in R.nearest_rank(df, ["op"], "duration", [0, 50, 95, 100]).collect()}
        for op, own in ((None, sorted(values[1::2])), ("a", sorted(values[::2]))):
            assert [got[op, p] for p in (0, 50, 95, 100)] == [own[min(len(own) * p // 100, len(own) - 1)] for p in (0, 50, 95, 100)]


def test_bands_split_small_and_large_values(spark):
    for low in (1e-5, 1e12):
        values = spark.range(100_000).select((F.lit(low) * (1 + F.col("id") / 100_000)).alias("v"))
        assert values.groupBy(R.band(F.col("v"))).count().agg(F.max("count")).first()[0] < 1000


def test_eviction_by_instants_with_unknown_ones(spark):
    rows = [(f"{k:064x}", 10, None if k % 5 == 0 else k // 3) for k in range(60)]
    blobs = spark.createDataFrame(rows, "hash string, size_bytes bigint, s bigint").withColumn("last_access", F.timestamp_seconds("s"))
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    for limit in (595, 555, 480, 100, 0):
        want = {r[0] for k, r in enumerate(order) if 10 * k < 600 - limit}
        assert {r.hash for r in B.eviction_plan(blobs, limit).collect()} == want


def test_listing_of_any_file_system(spark):
    from pyspark.errors import SparkRuntimeException

    from buildlens.sources.inventory import digests_of_listing

    digest = "ab" * 32
    for path, root in (("hdfs://nn/store/", "hdfs://nn/store"), ("file:/a[1]/b.c/", "/a[1]/b.c/"), ("/s/", "file:///s")):
        listing = spark.createDataFrame([(path + digest,), (path + ".tmp/" + digest,)], "path string")
        assert [r.hash for r in digests_of_listing(listing, root).collect()] == [digest]
    with pytest.raises(SparkRuntimeException):
        digests_of_listing(spark.createDataFrame([("/other/" + digest,)], "path string"), "/s").collect()
