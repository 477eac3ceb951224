"""Order-dependent work per key that does not put a hot key into one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one task. Here each key's rows are cut into
slices of about equal numbers of rows, windows run inside the slices, and one row per slice carries on what earlier
slices contribute: a prefix scan of two levels. Rows are cut by their whole order tuple, so a burst of rows at one
instant is cut too. A key of no more than ``MAX_SLICE_ROWS`` rows is one slice; the rows of larger keys are dealt by
range of (key, order), which Spark's own sampled range boundaries balance by rows, and the range is the slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.session import checkpointed, written

MAX_SLICE_ROWS = 1_000_000
SLICE = "_slice"


def cut(df: DataFrame, keys: list[str], order: list[str], max_rows: int = MAX_SLICE_ROWS) -> DataFrame:
    """``df`` with its slice: slices of one key follow each other in ``order`` and have some ``max_rows`` rows at most.

    ``order`` must be unique within a key. Keys are counted with a combined count. Large keys number no more than
    rows / ``max_rows``; they are written out, so Spark knows their size when it joins them. The dealt rows are
    checkpointed, as ranges drawn anew would not meet those drawn before.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    rows = counts.agg(F.sum("_n")).first()[0]
    if not rows:
        return df.withColumn(SLICE, F.lit(0))
    large = written(counts.drop("_n"), "large-keys")
    # ranges are half as long as they may be: boundaries come from a sample
    dealt = null_safe_join(df, large, keys, "left_semi").repartitionByRange(-(-2 * rows // max_rows), *keys, *order)
    dealt = checkpointed(dealt.withColumn(SLICE, F.spark_partition_id() + 1))
    rest = null_safe_join(df, large, keys, "left_anti")
    return rest.withColumn(SLICE, F.lit(0)).unionByName(dealt)


def order_number(df: DataFrame, column: str) -> Column:
    """An instant or a number as a whole number."""
    if dict(df.dtypes)[column].startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.floor(F.col(column)).cast("bigint")


def _sort(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def carry(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    peak: dict[str, Column] | None = None,
    *,
    include_current: bool = False,
    descending: bool = False,
    max_rows: int = MAX_SLICE_ROWS,
) -> DataFrame:
    """Add, per row, the latest non-null value (``last``), the sum (``total``) and the largest value (``peak``)
    over the key's earlier rows.

    ``descending`` looks at later rows instead, which turns ``last`` into "next". The full ``order`` list must be
    unique within a key. Rows that were ``cut`` before keep their slices; others are cut here.
    """
    last, total, peak = dict(last or {}), dict(total or {}), dict(peak or {})
    upto = Window.currentRow if include_current else -1
    rows = df if SLICE in df.columns else cut(df, keys, order, max_rows)
    part = [*keys, SLICE]
    w = Window.partitionBy(*part).orderBy(*_sort(order, descending)).rowsBetween(Window.unboundedPreceding, upto)
    position = F.struct(*order)
    edge = F.min_by if descending else F.max_by
    # slice 0 is a key's only one
    summary = rows.filter(F.col(SLICE) > 0).groupBy(*part).agg(
        *[edge(c, F.when(c.isNotNull(), position)).alias(f"_l_{n}") for n, c in last.items()],
        *[F.sum(c).alias(f"_t_{n}") for n, c in total.items()],
        *[F.max(c).alias(f"_p_{n}") for n, c in peak.items()],
    )
    over_slices = (
        Window.partitionBy(*keys).orderBy(*_sort([SLICE], descending)).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = summary.select(
        *part,
        *[F.last(f"_l_{n}", ignorenulls=True).over(over_slices).alias(f"_bl_{n}") for n in last],
        *[F.sum(f"_t_{n}").over(over_slices).alias(f"_bt_{n}") for n in total],
        *[F.max(f"_p_{n}").over(over_slices).alias(f"_bp_{n}") for n in peak],
    )
    local = rows.withColumns(
        {n: F.last(c, ignorenulls=True).over(w) for n, c in last.items()}
        | {n: F.sum(c).over(w) for n, c in total.items()}
        | {n: F.max(c).over(w) for n, c in peak.items()}
    )
    joined = null_safe_join(local, before, part)
    done = joined.withColumns(
        {n: F.coalesce(F.col(n), F.col(f"_bl_{n}")) for n in last}
        | {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_bt_{n}"), F.lit(0)) for n in total}
        | {n: F.greatest(F.col(n), F.col(f"_bp_{n}")) for n in peak}
    )
    helpers = [f"_bl_{n}" for n in last] + [f"_bt_{n}" for n in total] + [f"_bp_{n}" for n in peak]
    return done.drop(*helpers, *([] if SLICE in df.columns else [SLICE]))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join in which null keys meet; the right copies of the keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], **options) -> DataFrame:
    """Values of the row before; ``columns`` maps output name to source column."""
    held = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    out = carry(df, keys, order, last={"_prev": held}, **options)
    return out.withColumns({name: F.col("_prev")[name] for name in columns}).drop("_prev")


def following(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], **options) -> DataFrame:
    """Values of the row after."""
    return previous(df, keys, order, columns, descending=True, **options)


def latest_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key with their rank. Spark keeps only ``n`` per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_sort(order, True))
    return df.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)
