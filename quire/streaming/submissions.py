"""Submissions as a stream: arriving files, latest revision, incremental publication."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.session import checkpoint_dir
from quire.sources.files import located
from quire.sources.folders import stream_folders


def stream_submissions(
    spark: SparkSession, root: str, content: bool = True, lag: float = 2, every: float = 0, shares: int | None = None
) -> DataFrame:
    """New and changed files below ``root/manuscripts`` as micro-batches of inventory rows, metadata and empty files included.

    A file that is rewritten in place arrives again. ``lag`` is the time in seconds
    after which a modified file counts as finished; batches start at least ``every``
    seconds apart. Modification times must be those of the upload, as object
    stores give them: a file that is put there with an older time than the last
    batch's mark is not seen.
    """
    return located(stream_folders(spark, root, content, shares=shares, lag=lag, every=every), F.col("path"))


def latest_revision(rows: DataFrame, keys: Sequence[str], version: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The newest row per key, in a batch or in a stream (update or complete mode).

    ``max_by`` does not depend on arrival order, so an older revision that
    arrives late never replaces a newer one; it also combines before the
    shuffle, so a busy key is no bottleneck.
    """
    best = F.max_by(F.struct(*keep), F.struct(*version))
    return rows.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def drop_redelivered(stream: DataFrame, event_time: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Drop identical pushes delivered again within ``delay``, with bounded state.

    Keeps the first arrival, so it serves against redelivery and must not be
    used to pick the latest revision. The event time must be a TIMESTAMP.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def new_content(batch: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct rows of the batch whose (id, content hash) is not published yet."""
    return batch.dropDuplicates(list(keys)).join(published.select(*keys), list(keys), "left_anti")


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to; a new checkpoint gets a new one."""
    path = f"{checkpoint}-run"
    try:
        return spark.read.text(path).first()[0]
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    run = f"r{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(run).alias("value")).write.text(path)
    return run


def _prefix(keys: Sequence[str], digits: int) -> Column:
    return F.lower(F.substring(F.lpad(F.hex(F.xxhash64(*[F.col(k) for k in keys])), 16, "0"), 1, digits))


def published_keys(spark: SparkSession, index: str, prefixes: Sequence[str]) -> DataFrame | None:
    """Rows of the key index below these prefixes; only their folders are listed and read. None if there are none."""
    if not prefixes:
        return None
    try:
        return spark.read.option("basePath", index).parquet(f"{index}/prefix={{{','.join(sorted(prefixes))}}}")
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _write_index(rows: DataFrame, index: str, keys: Sequence[str], digits: int) -> None:
    keyed = rows.select(*keys, "run", "batch", _prefix(keys, digits).alias("prefix"))
    files = keyed.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    files.partitionBy("prefix", "run", "batch").parquet(index)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def publish_incremental(
    stream: DataFrame, table: str, keys: Sequence[str], checkpoint: str, query_name: str | None = None, digits: int = 2
) -> StreamingQuery:
    """Append unseen (id, content hash) rows to the Parquet table; unchanged articles write nothing.

    Each batch writes its own ``run=<run>/batch=<n>`` folder in overwrite mode, so
    a batch that is run again after a failure gives the same folder. The run is
    named in the checkpoint, beside the batch numbers: with a new checkpoint
    everything published stays.

    What is published already is looked up in ``<table>-keys``, the keys alone in
    folders by the first ``digits`` hex digits of their hash: a batch lists and
    reads the folders of its own prefixes (at most ``16 ** digits`` short texts on
    the driver), so its cost follows the batch and not the table. A table without
    such an index gets one before the first batch.
    """
    run, index = _run_of(stream.sparkSession, checkpoint), f"{table}-keys"

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = (F.lit(run).alias("run"), F.lit(number).cast("int").alias("batch"))
        rows = batch.persist()
        try:
            hit = [r[0] for r in rows.select(_prefix(keys, digits)).distinct().collect()]
            earlier = published_keys(spark, index, hit)
            new = rows.dropDuplicates(list(keys))
            if earlier is not None:
                earlier = earlier.filter((F.col("run") != run) | (F.col("batch") < number))
                new = new_content(rows, earlier, keys)
            new.write.mode("overwrite").parquet(f"{table}/run={run}/batch={number}")
        finally:
            rows.unpersist()
        written = spark.read.schema(batch.schema).parquet(f"{table}/run={run}/batch={number}")
        _write_index(written.select(*keys, *mine), index, keys, digits)

    if not _exists(stream.sparkSession, index) and _exists(stream.sparkSession, table):
        _write_index(stream.sparkSession.read.parquet(table), index, keys, digits)
    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    return writer.trigger(availableNow=True).start()


def run_available(
    stream: DataFrame, name: str, mode: str, reader: Callable[[str], DataFrame] | None = None, partitions: int | None = None
) -> DataFrame:
    """Run everything that has arrived through a stream and return the sink's rows.

    The state and the result live below ``spark.checkpoint.dir``; the result is
    the last complete batch, written by the executors. ``partitions`` is the number
    of tasks that hold the state, by default that of all shuffles.
    """
    spark = stream.sparkSession
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    base = f"{checkpoint_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions or usual)
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(save)
            .option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    if reader is not None:
        return reader(f"{base}/out")
    rows = spark.read.parquet(f"{base}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.filter(F.col("batch") == last)
    return rows.drop("batch")
