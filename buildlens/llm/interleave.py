"""Shards by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash and ranked within their source; ``(rank - offset) / rows of the source`` is a row's
fractional rank, where the offset in (0, 1] is a seeded hash of the source, so that small sources do not meet in one
place. Rows sorted by fractional rank are cut into equal shards: every contiguous run of that order holds each source in
proportion to its size.

Neither a source nor the table is ever sorted in one task. The hash, and later the fractional rank, deals rows into bins
of bounded size; counts of bins are summed along the order, and a row's place is its bin's start plus its place inside.

The law is ``rows``: counts of shards differ by at most one. Copies of a text may be in different shards, as one
group may hold a third of all rows. Null texts have size 1 and the crc32 of the empty text. A null source is a source of
its own. Rows with equal ids are ordered by their texts' crc32 and size; rows equal in these are interchangeable. Extra
columns are kept by ``interleaved``, whatever their names; ``shard`` and ``slot`` are replaced. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm.common import stored, table

#: Rows that a bin holds on average; a window orders no more than a few times as many.
BIN_ROWS = 5_000
SHARDS, SEED = 16, 17


def _unit(*columns: Column) -> Column:
    """A hash as a number from 0 up to, but not including, 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def places(rows: DataFrame, group: list[str], bin_col: str, order: list[Column], n: str, name: str) -> DataFrame:
    """``name``: the row's place from 0 in the order (bin, order) of its group; ``n``: the rows of the group."""
    counts = rows.groupBy(*group, bin_col).agg(F.count(F.lit(1)).alias("_in_bin"))
    earlier = Window.partitionBy(*group).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    starts = counts.select(*[F.col(c).alias(f"_g_{c}") for c in [*group, bin_col]], F.coalesce(F.sum("_in_bin").over(earlier), F.lit(0)).alias("_before"), F.sum("_in_bin").over(whole).alias(n))
    inside = Window.partitionBy(*group, bin_col).orderBy(*order)
    ranked = rows.withColumn("_inside", F.row_number().over(inside) - 1)
    meet = F.lit(True)
    for c in [*group, bin_col]:
        meet = meet & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    helpers = ["_inside", "_before", *[f"_g_{c}" for c in [*group, bin_col]]]
    return ranked.join(starts, meet).withColumn(name, F.col("_before") + F.col("_inside")).drop(*helpers)


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source", ties: tuple[str, ...] = ("doc_id",), bin_rows: int = BIN_ROWS) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (from 0 within the shard). ``ties`` name a row for the shuffle."""
    # own columns begin with an underscore, so those of the input that do are renamed until the end
    held: dict[str, str] = {}
    taken = {c.lower() for c in docs.columns}
    for c in docs.columns:
        if c.startswith("_"):
            name = f"own{c}"
            while name.lower() in taken:
                name = f"own{name}"
            taken.add(name.lower())
            held[c] = name
    docs, source, ties = docs.withColumnsRenamed(held), held.get(source, source), tuple(held.get(t, t) for t in ties)
    total = docs.count()
    bins = max(1, total // bin_rows)
    key = [F.col(c) for c in ties]
    rows = docs.withColumns({"_source": F.col(source), "_shuffle": _unit(F.lit(seed), *key)})
    rows = rows.withColumn("_bin", F.floor(F.col("_shuffle") * bins).cast("int"))
    rows = places(rows, ["_source"], "_bin", [F.col("_shuffle"), *key], "_rows", "_rank")
    fraction = (F.col("_rank") + _unit(F.lit(seed + 1), F.col("_source"))) / F.col("_rows")
    rows = rows.withColumn("_fraction", fraction).withColumn("_bin", F.least(F.floor(F.col("_fraction") * bins), F.lit(bins - 1)).cast("int"))
    # the order's few parts are summed as one group of counts; a constant group keeps the same code
    rows = places(rows.withColumn("_all", F.lit(0)), ["_all"], "_bin", [F.col("_fraction"), F.col("_source"), F.col("_shuffle"), *key], "_total", "_place")
    shard = F.floor(F.col("_place") * shards / F.lit(max(total, 1))).cast("int")
    first = F.ceil(F.col("_shard") * F.lit(max(total, 1)) / shards)
    return (
        rows.withColumn("_shard", shard)
        .withColumn("_slot", (F.col("_place") - first).cast("long"))
        .drop("_source", "_shuffle", "_bin", "_rows", "_rank", "_fraction", "_all", "_total", "_place", "shard", "slot")
        .withColumnsRenamed({"_shard": "shard", "_slot": "slot"})
        .withColumnsRenamed({name: c for c, name in held.items()})
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Shards as folders ``shard=N`` of Parquet files; ``slot`` is the order inside."""
    interleaved(docs, **options).write.partitionBy("shard").parquet(path)


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = interleaved(stored(digests, "shards"), ties=("doc_id", "text_crc32", "size"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_stratified_shards": op5_stratified_shards}
SQL: dict[str, str] = {}
