"""Append-only histories and summaries."""

from __future__ import annotations

import uuid

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildlens import schemas as S

#: Fields that number appends and the rows in them.
COMMIT, PLACE = "append_commit", "append_place"

#: Records repeat their field names and much of their text, so histories are kept as gzip. Such a file is read by one task,
#: so it holds this many records at most.
RECORDS_A_FILE = 1_000_000


def _append(records: DataFrame, ddl: str, path: str) -> None:
    """Add records under a commit number, which grows with the clock of the writer, and their place in it. Files of one
    write may end in any order; the two numbers keep that of the rows."""
    given = [F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl) if f.name in records.columns]
    numbered = [F.lit(time.time_ns() // 1000).alias(COMMIT), F.monotonically_increasing_id().alias(PLACE)]
    records.select(*given, *numbered).write.mode("append").option("maxRecordsPerFile", RECORDS_A_FILE).json(path, compression="gzip")


def _read(spark: SparkSession, ddl: str, path: str) -> DataFrame:
    """Records in the schema; lines that are none are dropped, missing numbers read as zero.

    ``ingest_order`` is the append order: the commit, then the place in it. Lines of other writers have neither; for
    them it is the time their file was written, then the place in the file.
    """
    schema = T.StructType.fromDDL(ddl)
    wide = T.StructType([*schema.fields, T.StructField(COMMIT, T.LongType()), T.StructField(PLACE, T.LongType())])
    rows = spark.read.schema(wide).option("mode", "DROPMALFORMED").json(path)
    zero = {f.name: F.coalesce(f.name, F.lit(0).cast("bigint")) for f in schema if isinstance(f.dataType, T.LongType)}
    foreign = F.col(COMMIT).isNull()
    order = F.struct(
        F.coalesce(COMMIT, F.unix_micros("_metadata.file_modification_time")).alias("commit"),
        F.when(foreign, F.col("_metadata.file_path")).alias("file"),
        F.when(foreign, F.col("_metadata.file_block_start")).alias("block"),
        F.coalesce(PLACE, F.monotonically_increasing_id()).alias("row"),
    )
    return rows.withColumn("ingest_order", order).withColumns(zero).drop(COMMIT, PLACE)


def append_target_history(executions: DataFrame, path: str) -> None:
    _append(executions, S.TARGET_HISTORY, path)


def append_test_history(executions: DataFrame, path: str) -> None:
    _append(executions, S.TEST_HISTORY, path)


def read_target_history(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, S.TARGET_HISTORY, path)


def read_test_history(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, S.TEST_HISTORY, path)


def _build_month() -> Column:
    month = F.substring("start_time", 1, 7)
    return F.when(month.rlike("^[0-9]{4}-[0-9]{2}$"), month).otherwise("unknown")


def write_summary(summary: DataFrame, path: str, version: int | Column = 0) -> None:
    """Store summaries under a version; a later version of an invocation replaces earlier ones on read.

    A version is a number, or a column of the summary that orders its versions.

    Rows are laid out by the month the build started, so time filters prune directories. Rebalancing keeps it to
    a few well-filled files per month and still splits a month that holds most rows.
    """
    rows = summary.withColumns({"version": F.lit(version).cast("bigint") if isinstance(version, int) else version, "build_month": _build_month()})
    rows.hint("rebalance", F.col("build_month")).write.mode("append").partitionBy("build_month").parquet(path)


# Compacted summaries lie beside the versions, in folders that plain readers of the path skip. A manifest has a row for
# each month (the folder with its newest rows) and for each file of versions that those folders replace.
_MANIFEST = "n bigint, month string, folder string, covered string"


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest committed manifest. It is one file, so it is there whole or not at all."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = rows.agg(F.max("n")).first()[0]
    return None if newest is None else rows.filter(F.col("n") == newest)


def _parts(spark: SparkSession, path: str) -> tuple[dict[str, str], list[str], list[str]]:
    """Folders of compacted months, files of versions that they replace, files of versions since then."""
    files = spark.read.parquet(path).inputFiles()
    rows = _manifest(spark, path)
    held = [] if rows is None else rows.collect()  # names of files and months, no data
    folders = {r["month"]: r["folder"] for r in held if r["month"] is not None}
    covered = {r["covered"] for r in held if r["covered"] is not None}
    return folders, [f for f in files if f in covered], [f for f in files if f not in covered]


def _month_of_file(file: str) -> str:
    return file.rsplit("/build_month=", 1)[1].split("/", 1)[0]


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The newest stored summary per invocation, from compacted months and the versions written since."""
    folders, _, fresh = _parts(spark, path)
    rows = spark.read.parquet(*folders.values(), *fresh)
    fields = [c for c in rows.columns if c not in ("version", "_version", "build_month", "invocation_id")]
    newest = rows.groupBy("invocation_id").agg(F.max_by(F.struct(*fields), "version").alias("s"))
    return newest.select("invocation_id", "s.*")


def compact_summaries(spark: SparkSession, path: str) -> list[str]:
    """Keep only the newest version of each invocation in the months that got new versions; returns those months.

    Versions stay comparable, so one that is written late, or again, still loses against a newer one. Months without new
    versions keep their folders. Until the manifest is written nothing changes for readers, and a run that breaks off
    leaves a folder that nobody reads; versions written meanwhile are in no manifest and are read beside it.
    """
    folders, covered, fresh = _parts(spark, path)
    months = sorted({_month_of_file(f) for f in fresh})
    if not months:
        return []
    base = f"{path}/_compacted/{uuid.uuid4().hex}"
    rows = spark.read.parquet(*[folders[m] for m in months if m in folders], *fresh)
    # rows of a month are those whose start says so, as it was when they were written
    rows = rows.withColumn("build_month", _build_month())
    names = [c for c in rows.columns if c not in ("build_month", "invocation_id")]
    newest = rows.groupBy("build_month", "invocation_id").agg(F.max_by(F.struct(*names), "version").alias("s"))
    newest.select("build_month", "invocation_id", "s.*").hint("rebalance", F.col("build_month")).write.partitionBy("build_month").parquet(base)
    folders |= {m: f"{base}/build_month={m}" for m in months}
    before = _manifest(spark, path)
    n = 0 if before is None else before.first()["n"] + 1
    entries = [(n, m, folder, None) for m, folder in folders.items()] + [(n, None, None, f) for f in covered + fresh]
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/_manifest")
    return months


def retention(events: DataFrame, now_us: int, days: int, ts: str = "ts") -> DataFrame:
    """Events younger than the retention period; the bound is a constant, so it is pushed to the scan."""
    oldest = F.timestamp_micros(F.lit(now_us - days * 86_400_000_000))
    return events.filter(F.col(ts) >= oldest)
