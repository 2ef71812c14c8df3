import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from quire.plans import workloads
from quire.session import checkpoint_dir
from quire.streaming import submissions
from quire.streaming.bounded import latest_bounded


def push(folder, name, rows, spark):
    at = [(i, v, datetime.datetime(2025, 1, d), h) for i, v, d, h in rows]
    frame = spark.createDataFrame(at, "id string, v int, at timestamp, hash string").toPandas()
    os.makedirs(folder, exist_ok=True)
    frame.to_parquet(f"{folder}/{name}.parquet", coerce_timestamps="us")


def read(spark, folder):
    schema = "id string, v int, at timestamp, hash string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


ROWS = ([("a", 3, 3, "x"), ("b", 1, 1, "y")], [("a", 2, 2, "z"), ("b", 4, 4, "y2")], [("a", 3, 3, "x")])


def test_late_revision_does_not_win(spark, tmp_path):
    folder = str(tmp_path / "in")
    for n, rows in enumerate(ROWS):
        push(folder, f"p{n}", rows, spark)
    latest = submissions.latest_revision(read(spark, folder), ["id"], [F.col("at"), F.col("v")], ["v", "hash"])
    got = submissions.run_available(latest, "late", "complete").collect()
    batch = submissions.latest_revision(spark.read.parquet(folder), ["id"], [F.col("at"), F.col("v")], ["v", "hash"])
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect())) == [("a", 3, "x"), ("b", 4, "y2")]


def test_publishing_twice_writes_nothing_new(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    push(folder, "p0", ROWS[0], spark)

    def publish(checkpoint):
        query = submissions.publish_incremental(read(spark, folder), table, ["id", "hash"], checkpoint)
        query.awaitTermination()
        return sorted((r.id, r.hash) for r in spark.read.parquet(table).collect())

    first = publish(str(tmp_path / "c"))
    assert first == [("a", "x"), ("b", "y")]
    assert publish(str(tmp_path / "c")) == first
    push(folder, "p1", ROWS[1], spark)
    push(folder, "p2", ROWS[2], spark)
    whole = [("a", "x"), ("a", "z"), ("b", "y"), ("b", "y2")]
    assert publish(str(tmp_path / "c")) == whole
    # a lost checkpoint loses nothing that is published
    assert publish(str(tmp_path / "other")) == whole


def test_submission_stream_reads_new_files(spark, root):
    stream = submissions.stream_submissions(spark, root, content=False)
    assert stream.isStreaming and "content" not in stream.columns
    got = submissions.run_available(stream.filter("area = 'source'"), "files", "append").collect()
    assert {(r.manuscript_id, r.path) for r in got} >= {("zip", "source/export.zip")}


def changes(spark, folder, state, out, **options):
    """Run what has arrived; (id, v, hash) given out so far."""
    stream = latest_bounded(read(spark, folder), ["id"], "at", ["v", "hash"], "2 days", version="v", **options)

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/b={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(((r.id, r.v, r.hash) for r in spark.read.parquet(out).collect()), key=str)


def test_late_pushes_do_not_overwrite_and_state_falls(spark, tmp_path):
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    push(folder, "p0", [("a", 3, 3, "x"), ("a", 1, 3, "w"), ("b", 1, 1, "y"), (None, 1, 2, "n")], spark)
    push(folder, "p1", [("a", 2, 2, "late"), ("b", 4, 4, "y2"), ("a", 3, 3, "again")], spark)
    got = changes(spark, folder, state, out)
    want = [("a", 3, "x"), ("b", 1, "y"), ("b", 4, "y2"), (None, 1, "n")]
    assert got == sorted(want, key=str)
    push(folder, "p2", [("c", 1, 20, "z")], spark)  # the watermark passes all that went before
    push(folder, "p3", [("a", 9, 2, "too late"), ("c", 2, 21, "z2")], spark)
    got = changes(spark, folder, state, out)
    assert got == sorted([*want, ("c", 1, "z"), ("c", 2, "z2")], key=str)
    kept = spark.read.format("statestore").option("stateVarName", "best").load(state).select("key.c0").distinct().collect()
    assert [r.c0 for r in kept] == ["c"]
    best = submissions.latest_revision(spark.read.parquet(out).join(spark.read.parquet(folder).where("hash <> 'too late'"), ["id", "v", "hash", "at"]), ["id"], [F.col("at"), F.col("v")], ["v"])
    assert sorted(map(tuple, best.collect())) == [("a", 3), ("b", 4), ("c", 2)]


def test_a_push_of_several_files_is_one_batch(spark, tmp_path):
    source, states = "/root/testdata/sf0.001", f"{checkpoint_dir(spark)}/quire-bounded-*"
    if not os.path.isdir(source):
        pytest.skip("benchmark tables are not here")
    spark.read.parquet(f"{source}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    before = set(glob.glob(states))
    got = workloads.bounded_latest_stream(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, workloads.latest_revision(spark, source).collect()))
    (state,) = set(glob.glob(states)) - before
    assert len(glob.glob(f"{state}/out/batch=*")) < 10  # five pushes, and batches without rows that only let state go


def test_a_batch_reads_the_prefixes_of_its_own_keys(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    push(folder, "p0", [(f"k{i}", 1, 1, "h") for i in range(300)], spark)

    def publish(checkpoint):
        submissions.publish_incremental(read(spark, folder), table, ["id", "hash"], checkpoint, digits=2).awaitTermination()
        return spark.read.parquet(table)

    assert publish(str(tmp_path / "c")).count() == 300
    index = f"{table}-keys"
    everything = spark.read.parquet(index)
    assert everything.count() == 300 and everything.select("prefix").distinct().count() > 100
    prefix = everything.where("id = 'k7'").first().prefix
    part = submissions.published_keys(spark, index, [prefix, "zz"])
    assert all(f"/prefix={prefix}/" in f for f in part.inputFiles()) and len(part.inputFiles()) < 10
    assert submissions.published_keys(spark, index, ["zz"]) is None and submissions.published_keys(spark, index, []) is None
    push(folder, "p1", [("k7", 1, 2, "h"), ("k7", 1, 2, "new")], spark)
    assert publish(str(tmp_path / "c")).count() == 301
    # a table from before there was an index gets one
    os.rename(index, f"{index}-away")
    assert publish(str(tmp_path / "other")).count() == 301


@pytest.mark.parametrize("name", ["latest_revision_stream", "redelivered_stream", "publish_stream"])
def test_streams_of_tables_that_are_folders(spark, tmp_path, name):
    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("benchmark tables are not here")
    for table in ("events", "documents"):
        spark.read.parquet(f"{source}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    query = getattr(workloads, name)
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(map(tuple, query(spark, source).collect()))
