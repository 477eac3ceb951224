"""Exact positions in an order: nearest-rank percentiles per group, and global cut points by running total.

Neither sorts a group in one task. Percentiles first collapse equal values, then locate the narrow value band
that holds each wanted position from per-band counts, and only order the few distinct values inside that band.
Cut points narrow an interval of the order column level by level; each level is one map-side combined histogram
over a scan whose interval filter is pushed down, so after the first level almost nothing is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.plans.ordered import null_safe_join, order_number

BANDS_PER_OCTAVE, PARTS = 256, 4096
#: Above the distance of any two binary exponents of doubles.
EXPONENTS = 1100


def band(value: Column) -> Column:
    """Monotone coarse band of a number: its sign and logarithm, 256 bands for each doubling, however small or large."""
    v = value.cast("double")
    level = F.floor((F.log2(F.abs(v)) + EXPONENTS) * BANDS_PER_OCTAVE)
    return F.when(F.isnan(v), 1 << 40).when(v == 0, 0).otherwise(F.signum(v) * level).cast("bigint")


def _with_offset(counts: DataFrame, by: list[str], order: str, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The row of ``counts`` (``_n`` rows each, in ``order`` within ``by``) in which each ``_offset`` falls, with what is left of it."""
    run = F.sum("_n").over(Window.partitionBy(*by).orderBy(order))
    met = null_safe_join(wanted, counts.withColumn("_upto", run), on, "inner")
    before = F.col("_upto") - F.col("_n")
    return met.filter((F.col("_offset") >= before) & (F.col("_offset") < F.col("_upto"))).withColumn("_offset", F.col("_offset") - before)


def values_at(df: DataFrame, keys: list[str], value: str, positions: DataFrame) -> DataFrame:
    """``positions``: keys + name + pos (0-based rank within the group) -> keys + name + value at that rank.

    The band of the position is found first, then its part among equal parts between the band's own least and largest
    value; only the distinct values of that part are ordered. Null keys are a group.
    """
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_band", band(F.col("_v")))
    number = F.col("_v").cast("double")
    bands = counted.groupBy(*keys, "_band").agg(F.sum("_c").alias("_n"), F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    wanted = _with_offset(bands, keys, "_band", positions.select(*keys, "name", F.col("pos").alias("_offset")), keys)
    rows = null_safe_join(counted, wanted.select(*keys, "_band", "name", "_offset", "_lo", "_hi"), [*keys, "_band"], "inner")
    share = (number - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    rows = rows.withColumn("_part", F.when(F.col("_hi") > F.col("_lo"), F.floor(share * (PARTS - 1))).otherwise(0))
    named = [*keys, "name"]
    parts = rows.groupBy(*named, "_part").agg(F.sum("_c").alias("_n"))
    chosen = _with_offset(parts, named, "_part", rows.groupBy(*named).agg(F.first("_offset").alias("_offset")), named)
    final = null_safe_join(rows.drop("_offset"), chosen.select(*named, "_part", "_offset"), [*named, "_part"], "inner")
    run = F.sum("_c").over(Window.partitionBy(*named).orderBy("_v"))
    return (
        final.withColumn("_run", run)
        .filter((F.col("_offset") >= F.col("_run") - F.col("_c")) & (F.col("_offset") < F.col("_run")))
        .select(*named, F.col("_v").alias("value"))
    )


def nearest_rank_position(n: Column, p: int) -> Column:
    """0-based ``min(floor(n*p/100), n-1)``: one higher than the ceiling rule whenever n*p/100 is whole."""
    return F.least(F.floor(n * F.lit(p) / F.lit(100)), n - 1).cast("bigint")


def group_positions(counts: DataFrame, keys: list[str], n: str, named: dict[str, Column]) -> DataFrame:
    """Long table of wanted positions from a per-group count."""
    entries = [F.struct(F.lit(k).alias("name"), c.cast("bigint").alias("pos")) for k, c in named.items()]
    return counts.filter(F.col(n) > 0).select(*keys, F.inline(F.array(*entries)))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percentiles: list[int]) -> DataFrame:
    """keys + percentile + value by the nearest-rank rule, exact."""
    counts = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    wanted = group_positions(
        counts, keys, "_n", {str(p): nearest_rank_position(F.col("_n"), p) for p in percentiles}
    )
    found = values_at(df.filter(F.col(value).isNotNull()), keys, value, wanted)
    return found.select(*keys, F.col("name").cast("int").alias("percentile"), "value")


LEVEL_BINS = 4096


def cut_point(df: DataFrame, number: str, weight: str, target: int) -> tuple[int, int] | None:
    """Smallest ``x`` such that the weight of rows with ``number <= x`` is at least ``target``.

    Returns ``(x, weight strictly before x)`` or None when the whole table weighs less. ``number`` is a whole
    number column. Only one bin row per level reaches the driver.
    """
    span = df.agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.sum(weight).alias("w")).first()
    if span["lo"] is None or span["w"] < target:
        return None
    lo, hi, before = int(span["lo"]), int(span["hi"]), 0
    while hi > lo:
        width = max(1, -(-(hi - lo + 1) // LEVEL_BINS))
        inside = df.filter(F.col(number).between(lo, hi))
        bins = inside.groupBy(F.floor((F.col(number) - F.lit(lo)) / F.lit(width)).cast("bigint").alias("bin")).agg(
            F.sum(weight).alias("w")
        )
        w = Window.orderBy("bin")  # at most LEVEL_BINS rows
        hit = (
            bins.withColumn("run", F.sum("w").over(w) + F.lit(before))
            .filter(F.col("run") >= target)
            .orderBy("bin")
            .first()
        )
        before = int(hit["run"] - hit["w"])
        lo, hi = lo + int(hit["bin"]) * width, min(hi, lo + (int(hit["bin"]) + 1) * width - 1)
    return lo, before


def _first_by_digest(ties: DataFrame, weight: str, target: int, tie: str) -> DataFrame:
    """Rows, in order of a hex digest, whose predecessors weigh less than ``target``; narrowed by its leading digits."""
    ties = ties.withColumn("_tie_number", F.conv(F.substring(F.col(tie), 1, 12), 16, 10).cast("bigint"))
    t, before = cut_point(ties, "_tie_number", weight, target)
    run = F.sum(weight).over(Window.partitionBy("_tie_number").orderBy(tie)) - F.col(weight)
    edge = ties.filter(F.col("_tie_number") == t).withColumn("_run", run).filter(F.col("_run") < target - before).drop("_run")
    return ties.filter(F.col("_tie_number") < t).unionByName(edge).drop("_tie_number")


def prefix_rows(df: DataFrame, number: str, weight: str, target: int, tie: str) -> DataFrame:
    """Rows, in order of ``number`` (a whole number or a timestamp, nulls first) then ``tie``, whose predecessors weigh
    less than ``target``. All rows before the cut value qualify outright; rows that share it are settled by ``tie``."""
    if target <= 0:
        return df.filter(F.lit(False))
    unknown = df.filter(F.col(number).isNull())
    weighed = int(unknown.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("w")).first()["w"])
    if weighed >= target:
        return _first_by_digest(unknown, weight, target, tie)
    whole = dict(df.dtypes)[number] in ("tinyint", "smallint", "int", "bigint")
    known = df.filter(F.col(number).isNotNull()).withColumn("_no", F.col(number) if whole else order_number(df, number))
    cut = cut_point(known, "_no", weight, target - weighed)
    if cut is None:
        return df
    x, before = cut
    edge = _first_by_digest(known.filter(F.col("_no") == x), weight, target - weighed - before, tie)
    return unknown.unionByName(known.filter(F.col("_no") < x).unionByName(edge).drop("_no"))
