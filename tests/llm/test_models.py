"""Language and quality: accuracy on rows held out, and odd inputs."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm.language import counts, identify, known, op4_language, portions, remainder
from quire.llm.quality import op7_quality, score
from quire.llm.words import texts_of

FOLDER = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables are not here")


def hash_of(doc_id, by):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % by


def test_remainder_is_that_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", remainder(F.col("id"), 3).alias("r")).collect()
    assert all(r.r == hash_of(r.id, 3) for r in rows)


@here
def test_language_of_held_out_documents(spark):
    rows = op4_language(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (hash_of(r.doc_id, 3) == 1) for r in rows)


@here
def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    rows = op7_quality(spark, FOLDER)
    assert rows.count() == 1000
    held = [r for r in rows.join(labels, "doc_id").collect() if r.held_out]
    right = sum(r.predicted == r.quality for r in held)
    assert right >= 0.9 * len(held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)


ODD = [(1, "the cat sat on the mat and the dog", "en"), (2, "le chat est sur la table et le chien", "fr"), (3, None, "en"), (4, "", "fr"), (5, "123 !!", None), (6, "Ж", None), (7, "the dog", None), (None, "le chien", "fr"), (1, "the cat sat on the mat and the dog", "en"), (8, "the " * 40000, "en")]


def test_language_of_odd_rows(spark, documents):
    docs = documents(ODD).withColumnRenamed("source", "score")
    rows = identify(docs, learn=remainder(F.col("doc_id"), 3) != 9).collect()
    assert len(rows) == len(ODD) and set(rows[0].asDict()) == {"doc_id", "text", "lang", "n_chars", "lang_pred", "score", "rejected"}
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].rejected and by_id[i].score == 0 for i in (3, 4, 5))
    assert by_id[6].lang_pred in ("en", "fr") and by_id[6].rejected
    assert by_id[7].lang_pred == "en" and by_id[None].lang_pred == "fr" and by_id[8].lang_pred == "en"
    kept = known(documents(ODD))
    assert kept.columns == documents(ODD).columns and not {3, 4, 5, 6} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(spark, documents):
    rows = identify(documents([(1, "abc", None)])).collect()
    assert [(r.lang_pred, r.rejected) for r in rows] == [("und", True)]
    assert identify(documents([])).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in score(documents(["abc", None]), none, F.lit(True)).collect()] == [0.5, 0.5]
    assert score(documents([]), none, F.lit(True)).count() == 0


def test_quality_of_odd_rows(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (1, 1, None), (None, 1, 0), (7, None, 0), (99, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    rows = score(documents(ODD), labels, F.lit(True)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    one = score(documents(ODD), labels.where("quality = 1"), F.lit(True)).collect()
    assert {r.score for r in one} == {1.0}


def test_language_portions_are_small():
    words = [f"word{i}" for i in range(3000)] + ["long text " * 60000, "", "end"]
    texts = texts_of(pa.array(words))
    tracemalloc.start()
    try:
        found = [(first, last, counts(part).sum(axis=1)) for first, last, part in portions(texts)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [f for f, _, _ in found] == [0, *[last for _, last, _ in found[:-1]]] and found[-1][1] == len(words)
    assert peak < 150 << 20
    whole = np.concatenate([c for _, _, c in found])
    assert (whole[:3000] == counts(texts_of(pa.array(words[:3000]))).sum(axis=1)).all() and whole[3001] == 0
