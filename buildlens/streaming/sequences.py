"""Streams of numbered messages, and operations that fall silent while nothing else happens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from buildlens.streaming.builds import use_rocksdb

PROGRESS = ["version", "acknowledged", "contiguous", "gaps", "missing", "resent", "filled"]


def merged_ranges(ranges: np.ndarray) -> np.ndarray:
    """Ranges (first, last) of whole numbers, in order, with those that touch or overlap joined."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    begins = np.flatnonzero(np.concatenate(([True], ranges[1:, 0] > reach[:-1] + 1)))
    return np.stack([ranges[begins, 0], reach[np.append(begins[1:], len(ranges)) - 1]], 1)


class Acknowledged(StatefulProcessor):
    """The numbers heard on a stream as merged ranges, so that state grows with the gaps and not with the messages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranges = handle.getListState("ranges", "first bigint, last bigint")
        self.count = handle.getValueState("count", "rows bigint, version bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = np.array([tuple(r) for r in self.ranges.get()] if self.ranges.exists() else [], np.int64).reshape(-1, 2)
        heard, version = self.count.get() if self.count.exists() else (0, 0)
        top = held[-1, 1] if len(held) else None
        ranges = held
        for pdf in rows:
            numbers = pdf["sequence_number"].to_numpy(np.int64)
            heard += len(numbers)
            ranges = merged_ranges(np.concatenate([ranges, np.stack([np.unique(numbers)] * 2, 1)]))
        self.ranges.put([(int(a), int(b)) for a, b in ranges])
        self.count.update((int(heard), version + 1))
        distinct = int((ranges[:, 1] - ranges[:, 0] + 1).sum())
        missing = int((ranges[1:, 0] - ranges[:-1, 1] - 1).sum())
        # numbers up to the highest of before that were missing and have come now
        before = 0 if top is None else int((held[:, 1] - held[:, 0] + 1).sum())
        now = 0 if top is None else int(np.maximum(np.minimum(ranges[:, 1], top) - np.maximum(ranges[:, 0], held[0, 0]) + 1, 0).sum())
        yield pd.DataFrame([[key[0], version + 1, int(ranges[-1, 1]), int(ranges[0, 1]), len(ranges) - 1, missing, int(heard) - distinct, now - before]], columns=["stream_id", *PROGRESS])

    def close(self) -> None:
        pass


def ack_stream(events: DataFrame) -> DataFrame:
    """Progress of each stream (stream_id, sequence_number), a row at every batch that has messages of it; the one of the
    highest version holds.

    ``acknowledged`` is the highest number, ``contiguous`` the end of the first range without a gap, ``filled`` how many
    numbers that had been missing came. Batches may come in any order. Null numbers are left out.
    """
    use_rocksdb(events.sparkSession)
    rows = events.filter(F.col("sequence_number").isNotNull()).select(F.col("stream_id").cast("bigint"), F.col("sequence_number").cast("bigint"))
    return rows.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=Acknowledged(),
        outputStructType="stream_id bigint, " + ", ".join(f"{c} bigint" for c in PROGRESS),
        outputMode="Append",
        timeMode="None",
    )


class Stuck(StatefulProcessor):
    """Report an operation that has not ended and of which nothing was heard for the limit, by the clock."""

    def __init__(self, limit_ms: int, final: tuple[str, ...]) -> None:
        self.limit_ms, self.final = limit_ms, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ts_us bigint, seq bigint, stage string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max((tuple(r) for pdf in rows for r in pdf[["us", "seq", "stage"]].itertuples(index=False)), default=None)
        if self.latest.exists():
            newest = max(newest, tuple(self.latest.get()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.latest.update((int(newest[0]), int(newest[1]), str(newest[2])))
        if newest[2] not in self.final:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us, seq, stage = self.latest.get()
        yield pd.DataFrame({"operation_id": [key[0]], "stage": [stage], "seq": [seq], "last_us": [us]})

    def close(self) -> None:
        pass


def stuck_operation_stream(log: DataFrame, limit_seconds: float = 60, final: tuple[str, ...] = ("Completed", "Failed")) -> DataFrame:
    """Operations (operation_id, ts, seq, stage) that fall silent for ``limit_seconds`` of the clock without having ended.

    A timer reports them, so no further message is needed; a message after that starts the watch anew.
    """
    use_rocksdb(log.sparkSession)
    rows = log.select(F.col("operation_id").cast("bigint"), F.unix_micros("ts").alias("us"), "seq", "stage")
    return rows.groupBy("operation_id").transformWithStateInPandas(
        statefulProcessor=Stuck(int(limit_seconds * 1000), final),
        outputStructType="operation_id bigint, stage string, seq bigint, last_us bigint",
        outputMode="Append",
        timeMode="ProcessingTime",
    )
