"""Finalisation of builds by a join of two streams: what a build reported, and the mark that it is over.

The first mark of each build in a batch is picked by task, and kept by Spark's own removal of duplicates; completions and
tests meet it in Spark's own stream-stream join. A row of that join's state costs several look-ups, so rows and marks enter it
in packs: what a batch has of the builds of one key, as arrays. Both states are spilled to RocksDB and given up as the
watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from buildlens.streaming.builds import live_build_summary, use_rocksdb

#: Kinds whose rows a build leaves when it is over.
REPORTED = ["TargetComplete", "TestResult"]

#: Keys of the join's state. Builds share one only where there are about as many builds or more.
KEYS = 1 << 20

#: Groups in which Spark sorts rows before they are packed.
SHEAVES = 1 << 12

#: For the session of a stream whose labels are short: Spark else adds up the bytes of a batch for Python after each row of it.
BY_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}

#: Most rows in a pack, and bytes that a task gathers before it packs them.
PACK, HELD_BYTES = 1024, 64 << 20

#: Marks that a task gathers before it keeps only the first of each build.
GATHERED = 1_000_000


def _first_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the marks of one task, for each build the one with the smallest number."""

    def reduced(tables: list[pa.Table]) -> pa.Table:
        marks = pa.concat_tables(tables).sort_by([("invocation_id", "ascending"), ("done_at", "ascending"), ("done_ts", "ascending")])
        of = marks["invocation_id"].to_numpy()
        return marks.filter(pa.array(np.append(True, of[1:] != of[:-1])))

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
        if n >= GATHERED:
            held, n = [reduced(held)], 0
    if held:
        yield from reduced(held).to_batches()


def finish_marks(events: DataFrame, hours: int) -> DataFrame:
    """(invocation_id, done_at, done_ts): the number and time at which each build was over, at its BuildFinished or its last
    message, whichever comes first: of the first batch that has any, the one with the smallest number. A build's mark is
    remembered until the watermark has passed it by ``hours``."""
    use_rocksdb(events.sparkSession)
    marks = events.filter((F.col("kind") == "BuildFinished") | F.coalesce(F.col("last_message"), F.lit(False)))
    marks = marks.select("invocation_id", F.col("sequence_number").alias("done_at"), F.col("ts").alias("done_ts"))
    marks = marks.filter("invocation_id IS NOT NULL").repartition("invocation_id").mapInArrow(_first_marks, marks.schema)
    return marks.withWatermark("done_ts", f"{hours} hours").dropDuplicatesWithinWatermark(["invocation_id"])


def _packs(held: list[pa.RecordBatch], hours: int) -> Iterator[pa.RecordBatch]:
    """One row for each key and slice of ``hours``, or several where there are many rows: the newest time, each column as array."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    times = lambda: rows["ts"].cast(pa.int64()).to_numpy()
    rows = rows.take(pa.array(np.lexsort((times() // (hours * 3_600_000_000), rows["_key"].to_numpy()))))
    key, us = rows["_key"].to_numpy(), times()
    part = us // (hours * 3_600_000_000)
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
    first = np.flatnonzero((np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key)))) % PACK == 0)
    offsets = pa.array(np.append(first, len(key)), pa.int32())
    newest = pa.array(np.maximum.reduceat(us, first)).cast(rows["ts"].type)
    lists = {c: pa.ListArray.from_arrays(offsets, rows[c]) for c in rows.schema.names if c != "_key"}
    yield from pa.table({"_key": key[first], "_newest": newest} | lists).to_batches(max_chunksize=PACK)


def _packed(hours: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from _packs(held, hours)
                held, size = [], 0
        if held:
            yield from _packs(held, hours)

    return packed


def packs(rows: DataFrame, hours: int) -> DataFrame:
    """What a batch has of the builds of each key, from one slice of ``hours``, as arrays, with the newest ``ts``, which takes
    over the watermark. No row is older than that by ``hours``."""
    key = F.pmod(F.xxhash64("invocation_id"), F.lit(KEYS)).cast("int")
    rows = rows.filter("invocation_id IS NOT NULL AND ts IS NOT NULL")
    times = rows.schema["ts"]
    schema = StructType([StructField("_key", IntegerType(), True), StructField("_newest", times.dataType, True, times.metadata)])
    for field in rows.schema:
        schema.add(field.name, ArrayType(field.dataType))
    return rows.select("*", key.alias("_key")).groupBy(F.col("_key") % SHEAVES).applyInArrow(_packed(hours), schema)


def finalize_build(events: DataFrame, hours: int = 24) -> DataFrame:
    """Targets and tests of finished builds: each row once, as soon as both it and its build's mark are there.

    ``events``: invocation_id, kind, last_message, label, success, sequence_number, ts. Rows after the mark are ``late``.
    Rows meet a mark that lies up to ``hours`` before or after them; state older than twice that is released. A row older than
    the watermark is dropped, unless newer ones of its key and slice of time come with it.
    """
    # one store holds both sides of a partition, not four
    events.sparkSession.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")
    marks = finish_marks(events, hours).withColumnRenamed("done_ts", "ts")
    said = F.array_position(F.lit(REPORTED), F.col("kind")) * 3 + F.coalesce(F.col("success").cast("int"), F.lit(2))
    rows = events.filter(F.col("kind").isin(REPORTED)).select("invocation_id", said.cast("byte").alias("said"), "label", "sequence_number", "ts")
    own = packs(marks, hours).toDF("_of", "_over", "_builds", "_done_at", "_done_ts")
    # the newest of two packs lie apart by what a row and its mark may, and by what a pack spans
    reach = F.make_interval(hours=F.lit(2 * hours))
    met = (F.col("_key") == F.col("_of")) & (F.col("_newest") >= F.col("_over") - reach) & (F.col("_newest") <= F.col("_over") + reach)
    # the left side of a batch is stored first, and read by the right side: marks are the smaller ones
    each = own.join(packs(rows.withWatermark("ts", f"{hours} hours"), hours), met).select("*", F.posexplode("said").alias("_i", "_said"))
    names = ["invocation_id", "label", "sequence_number", "ts"]
    each = each.select("_builds", "_done_at", "_done_ts", "_said", *[F.get(c, F.col("_i")).alias(c) for c in names])
    place = (F.array_position("_builds", F.col("invocation_id")) - 1).cast("int")
    each = each.select("*", F.get("_done_at", place).alias("done_at"), F.get("_done_ts", place).alias("done_ts"))
    each = each.filter(F.abs(F.unix_micros("ts") - F.unix_micros("done_ts")) <= hours * 3_600_000_000)
    kind = F.get(F.lit(REPORTED), F.expr("CAST(_said DIV 3 AS INT) - 1")).alias("kind")
    success = F.get(F.array(F.lit(False), F.lit(True)), F.col("_said") % 3).alias("success")
    return each.select("invocation_id", kind, "label", success, "sequence_number", (F.col("sequence_number") > F.col("done_at")).alias("late"))


def final_summaries(events: DataFrame) -> DataFrame:
    """The summary of each build that is over, and again at each event that comes later; in update mode."""
    return live_build_summary(events).filter(F.col("status") != "in_progress")
