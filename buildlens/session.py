"""Session settings shared by the operators: clock zone, shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Runtime settings. All instants in the data are UTC. A hot key on one side of a join is split even where the
# split costs a further shuffle, as in a join whose result is grouped by the same key.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tuned_builder(master: str | None = None, app: str = "buildlens") -> SparkSession.Builder:
    """Builder with the settings the operators assume; a cluster submits its own master."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # plans here have hundreds of expressions; recording the Python call site of each costs more than the plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    for key, value in RUNTIME.items():
        b = b.config(key, value)
    return b.master(master) if master else b


def prepared(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh local one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors of a cluster share no local folder")
    if not named:
        named = tempfile.mkdtemp(prefix="buildlens-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, below the shared folder."""
    return f"{shared_dir(spark)}/buildlens/{name}-{uuid.uuid4().hex}"


def checkpointed(df, name: str = "frame"):
    """Reliable checkpoint: survives executor loss, unlike an executor-local one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df, name: str):
    """``df`` as Parquet in the shared folder, read again: its size is known, and its lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
