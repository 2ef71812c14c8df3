"""Reading tables and keeping intermediate results where every executor can read them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import checkpoint_dir

Compute = Callable[[pa.Array], Iterable[tuple[int, int, list[pa.Array]]]]

#: Bytes of an Arrow batch. A task holds a few batches at a time, in the JVM and in Python, whatever the length of the rows.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most ``BATCH_BYTES``, or one row that is longer; a lower setting stays."""
    number, unit = re.match(r"(\d+)\s*([kmgtp]?)", spark.conf.get(_BATCH).strip().lower()).groups()
    if int(number) * 1024 ** ("kmgtp".index(unit) + 1 if unit else 0) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """Write once below ``spark.checkpoint.dir`` and read from there: cuts lineage, survives lost executors."""
    bounded(df.sparkSession)
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    return F.col(quoted(name))


def extended(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], compute: Compute) -> DataFrame:
    """``df`` with columns that ``compute`` makes of a text column, batch by batch; others of those names are replaced.

    ``compute`` gets a batch's texts and gives, for consecutive ranges of them, (first, last + 1, a column per field).
    Column names don't matter on the way, so any are allowed.
    """
    bounded(df.sparkSession)
    new = {n.lower() for n, _ in fields}
    safe = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in new]
    safe = safe.select(*[f"c{i}" for i in kept])
    place = kept.index(df.columns.index(text))
    added = [T.StructField(f"n{i}", t) for i, (_, t) in enumerate(fields)]
    schema = T.StructType([*safe.schema.fields, *added])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, columns in compute(batch.column(place)):
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=names)

    return safe.mapInArrow(run, schema).toDF(*[df.columns[i] for i in kept], *[n for n, _ in fields])
