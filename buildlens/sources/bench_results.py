"""Benchmark result files as long metric tables, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    out: list[str] = []
    for f in schema:
        name = f"{prefix}`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += _leaves(f.dataType, name + ".")
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(name)
    return out


def to_metrics(rows: DataFrame, run: str, missing: str = "N/A") -> DataFrame:
    """Wide, possibly nested rows -> (run, metric, text, value). Nested keys are joined with dots."""
    leaves = [c for c in _leaves(rows.schema) if c.replace("`", "") != run]
    pairs = [
        F.struct(F.lit(c.replace("`", "")).alias("metric"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("text"))
        for c in leaves
    ]
    long = rows.select(F.col(run).alias("run"), F.inline(F.array(*pairs)))
    return long.withColumn("value", F.col("text").try_cast("double"))


def read_bench_json(spark: SparkSession, path: str, run: str, schema=None, multi_line: bool = True) -> DataFrame:
    """Run summaries, one JSON document per file (or per line)."""
    reader = spark.read.option("multiLine", multi_line)
    return to_metrics((reader.schema(schema) if schema else reader).json(path), run)


def read_bench_csv(spark: SparkSession, path: str, run: str) -> DataFrame:
    return to_metrics(spark.read.option("header", "true").csv(path), run)


def latest_run_per_family(files: DataFrame) -> DataFrame:
    """Newest file per family: the name up to its time stamp."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    family = F.regexp_replace(name, r"_[0-9][0-9_]*\.[a-z]+$", "")
    return files.groupBy(family.alias("family")).agg(
        F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified")
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("modificationTime").alias("modified"))


def write_report(report: DataFrame, path: str) -> None:
    """The report as JSON lines and as CSV with a header, beside each other."""
    report.write.mode("overwrite").json(f"{path}/json")
    report.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
