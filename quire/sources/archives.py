"""Archives made of texts."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.BinaryType())
def _zipped(members: pa.Array) -> pa.Array:
    out = []
    for row in members.to_pylist():
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, text in row or ():
                archive.writestr(zipfile.ZipInfo(name), text or "")  # a fixed time: equal members make equal archives
        out.append(None if row is None else buffer.getvalue())
    return pa.array(out, pa.binary())


def archived(members: Column) -> Column:
    """A ZIP archive of a map from names to texts, in map order; null for null."""
    return _zipped(members)
