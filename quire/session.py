"""Session settings the operators rely on, and the places they write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the per-row work is heavy, so small stages should still use every core
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # no Python call site per Column: large expressions build several times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches carry whole documents, so count rows conservatively
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

_local_folder: str | None = None  # of local sessions that name none; the setting itself can't be changed later


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", name: str = "quire") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session that names none gets a fresh temporary folder; on
    a cluster a machine-local folder would be wrong, so the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="spark-quire-")
    return _local_folder


def settled(df: DataFrame) -> DataFrame:
    """Compute once into a table below the shared checkpoint folder; later uses read it from there.

    One pass over the data, where ``DataFrame.checkpoint`` takes two, and later
    reads are pruned to the columns they need. The table stays until whoever owns
    the checkpoint folder empties it: results read from it when they are used.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
