import numpy as np
import pyarrow as pa

from quire.llm import tables
from quire.llm.jaccard import sketches
from quire.llm.tables import extended
from quire.llm.words import mix
from pyspark.sql import types as T


def test_batches_hold_few_bytes_whatever_the_number_of_rows(spark, documents):
    docs = documents(["some words " * 2000] * 600, 1)
    before = {k: spark.conf.get(k) for k in (tables._BATCH, "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")

        def size(batch):
            yield 0, len(batch), [pa.array([batch.nbytes] * len(batch))]

        rows = extended(docs, "text", [("size", T.LongType())], size).select("text", "size").collect()
        assert len(rows) == 600
        assert max(r["size"] for r in rows) <= tables.BATCH_BYTES + 2 * 22000
        for given, kept in (("1m", "1m"), ("1048576b", "1048576b"), ("64m", str(tables.BATCH_BYTES))):
            spark.conf.set(tables._BATCH, given)
            tables.bounded(spark)
            assert spark.conf.get(tables._BATCH) in (kept, f"{kept}b")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sketches_take_at_most_a_sixteenth_of_the_sets():
    values = mix(np.arange(1000, dtype=np.uint64))
    assert len(sketches(np.sort(values), np.array([0, 1000]))[0].as_py()) * 16 <= values.nbytes
