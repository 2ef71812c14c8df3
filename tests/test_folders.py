import io
import os
import time
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import write
from quire.sources import exact
from quire.sources import files as scans
from quire.sources.exact import ExactFiles, _Writer, write_exact
from quire.sources.folders import read_folders
from quire.streaming import submissions


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_many_tasks_list_many_folders(spark, tmp_path):
    for i in range(300):
        write(tmp_path / f"manuscripts/m{i}/_metadata.yml", "a: 1" if i % 2 else "")
    write(tmp_path / "manuscripts/stray.txt", "not in a folder")
    found = read_folders(spark, str(tmp_path), shares=7)
    assert found.rdd.getNumPartitions() == 7
    shares = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(shares) == 7 and max(r["count"] for r in shares) < 100
    got = scans.scan_files(spark, str(tmp_path)).collect()
    assert sorted((r.manuscript_id, r.name, r.length) for r in got) == sorted((f"m{i}", "_metadata.yml", 4 * (i % 2)) for i in range(300))
    texts = {r.manuscript_id: r.text for r in scans.scan_registry(spark, f"file://{tmp_path}").collect()}
    assert texts["m1"] == "a: 1" and texts["m2"] == "" and len(texts) == 300


def test_many_tasks_list_what_lies_in_few_folders(spark, tmp_path):
    for i in range(300):
        write(tmp_path / f"manuscripts/m{i % 2}/d{i}/article.xml", "x" * i)
    write(tmp_path / "manuscripts/m0/top.md", "t")
    write(tmp_path / "manuscripts/m0/d0/a/b/deep.md", "")
    found = read_folders(spark, str(tmp_path), content=True, shares=7)
    shares = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(shares) == 7 and max(r["count"] for r in shares) < 100
    want = [(f"/manuscripts/m{i % 2}/d{i}/article.xml", i) for i in range(300)] + [("/manuscripts/m0/top.md", 1), ("/manuscripts/m0/d0/a/b/deep.md", 0)]
    assert sorted((r.path, len(r.content)) for r in found.collect()) == sorted(want)


def test_no_folder_yet(spark, tmp_path):
    assert read_folders(spark, str(tmp_path)).count() == 0


def test_changed_files_arrive_once_per_revision(spark, tmp_path):
    root, state, out = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "out")
    write(root / "manuscripts/a/_metadata.yml", "one")
    write(root / "manuscripts/a/article.qmd", "text")
    write(root / "manuscripts/b/empty.txt", "")

    def arrived():
        rows = submissions.stream_submissions(spark, str(root), lag=0, shares=3)
        query = rows.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.manuscript_id, r.path, bytes(r.content).decode()) for r in spark.read.parquet(out).collect())

    first = [("a", "_metadata.yml", "one"), ("a", "article.qmd", "text"), ("b", "empty.txt", "")]
    assert arrived() == first
    assert arrived() == first  # a restart repeats nothing
    time.sleep(0.05)
    write(root / "manuscripts/a/_metadata.yml", "two")
    write(root / "manuscripts/c/new.md", "n")
    assert arrived() == sorted([*first, ("a", "_metadata.yml", "two"), ("c", "new.md", "n")])
    assert arrived() == sorted([*first, ("a", "_metadata.yml", "two"), ("c", "new.md", "n")])


def test_lag_leaves_fresh_files_for_later(spark, tmp_path):
    write(tmp_path / "manuscripts/a/x.md", "x")
    rows = submissions.stream_submissions(spark, str(tmp_path), content=False, lag=3600)
    assert submissions.run_available(rows, "lag", "append", reader=lambda path: path) and rows.isStreaming


def test_exact_names_stay_in_their_folder(spark, tmp_path):
    rows = [("../../a/b", "x/y.xml", "1"), ("..", ".", "2"), ("ok", "é ü.txt", "ünï"), ("ok", None, "3"), ("", "n", "4"), ("ok", "null.txt", None), ("b\\c", "a%2Fb", "5")]
    frame = spark.createDataFrame(rows, "folder string, file_name string, content string").repartition(3)
    folder = tmp_path / "out"
    assert write_exact(frame, str(folder)) == 4
    assert listed(tmp_path) == ["out/%2E%2E/%2E", "out/%2E%2E/%2E%2E/a/b/x%2Fy.xml", "out/b%5Cc/a%2Fb", "out/ok/é ü.txt"]
    assert (folder / "ok/é ü.txt").read_text() == "ünï"
    again = spark.createDataFrame([("ok", "é ü.txt", "new")], frame.schema)
    assert write_exact(again, str(folder)) == 1 and (folder / "ok/é ü.txt").read_text() == "new"
    assert write_exact(frame.limit(0), str(folder)) == 0


def test_two_rows_of_one_place_write_nothing(spark, tmp_path):
    frame = spark.createDataFrame([("a", "b", "1"), ("a", "b", "2")], "folder string, file_name string, content string")
    with pytest.raises(ValueError, match="2 rows for a/b"):
        write_exact(frame, str(tmp_path / "out"))
    assert listed(tmp_path) == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(ExactFiles)
    broken = spark.range(20).selectExpr("'f' folder", "string(id) file_name", "if(id = 19, cast(raise_error('broken') as binary), cast('x' as binary)) content")
    with pytest.raises(Exception, match="broken"):
        broken.repartition(4, "file_name").write.format("exact_files").option("job", "j").mode("append").save(str(tmp_path))
    assert listed(tmp_path) == []


def test_only_committed_attempts_count(spark, tmp_path):
    writer = _Writer(str(tmp_path), "j")
    rows = [{"folder": "a", "file_name": "x", "content": b"1"}]
    writer.write(iter([{"folder": "a", "file_name": "stray", "content": b"half"}]))  # an attempt that was lost
    good = writer.write(iter(rows))
    writer.commit([good])
    assert f'["{good.folder}"]' == (tmp_path / ".staging-j/committed.json").read_text()


def test_staging_holds_few_folders_and_a_repeated_move_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "_PORTION", 3)
    writer = _Writer(str(tmp_path), "j")
    attempt = writer.write(iter([{"folder": f"f{i}/g", "file_name": "x", "content": b"%d" % i} for i in range(7)])).folder
    staging = tmp_path / ".staging-j" / attempt
    assert sorted(os.listdir(staging)) == ["0", "1", "2"] and listed(staging / "2") == ["0", "places.json"]
    for moved in (7, 0):
        batch = pa.RecordBatch.from_arrays([pa.array([f"{attempt}/{p}" for p in range(3)])], names=["portion"])
        assert sum(b.column(0)[0].as_py() for b in exact._moved(str(tmp_path), "j")(iter([batch]))) == moved
        assert [(tmp_path / f"f{i}/g/x").read_text() for i in range(7)] == list("0123456")


def test_archives_are_opened_where_they_lie(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("a/one.tex", "1" * 10)
        archive.writestr("big.bin", bytes(3 << 20))
        archive.mkdir("empty")
        archive.writestr("two.tex", "")
    write(tmp_path / "manuscripts/m/source/x.zip", buffer.getvalue())
    write(tmp_path / "manuscripts/m/source/broken.zip", b"PK no archive")
    write(tmp_path / "manuscripts/m/deep/source/y.zip", buffer.getvalue())
    files = scans.scan_files(spark, str(tmp_path))
    rows = scans.unpack_archives(str(tmp_path), files, largest=1 << 20)
    got = sorted((r.path or "", r.length, r.content and bytes(r.content), bool(r.error)) for r in rows.collect())
    assert got == [("", 0, None, True), ("source/a/one.tex", 10, b"1" * 10, False), ("source/big.bin", 3 << 20, None, True), ("source/two.tex", 0, b"", False)]
    whole = scans.unpack_archives(str(tmp_path), files).where("error is null")
    assert {r.path: len(r.content) for r in whole.collect()} == {"source/a/one.tex": 10, "source/big.bin": 3 << 20, "source/two.tex": 0}


def test_articles_are_read_by_the_tasks_that_list(spark, tmp_path):
    for i in range(60):
        write(tmp_path / f"manuscripts/m {i}+%41/article.qmd", "---\r\na: 1\r\n---\r\nx" if i else "")
    write(tmp_path / "manuscripts/m 1+%41/sub/article.qmd", "not the article")
    for hidden in ("_T", ".h"):
        write(tmp_path / f"manuscripts/{hidden}/article.qmd", "hidden")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        inventory, articles = scans.scan_files(spark, str(tmp_path)), scans.scan_canonical(spark, str(tmp_path))
        for found in (inventory, articles):  # each share reads all names of the top folder; a file source would list on the driver
            assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
            assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.manuscript_id, r.front_matter, r.body) for r in articles.collect()) == sorted((f"m {i}+%41", "a: 1", "x") for i in range(1, 60))
    assert inventory.count() == 63
