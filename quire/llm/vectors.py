"""Embedding near-duplicates as an exact metric range join.

Unit vectors with a cosine of at least 0.98 lie within a Euclidean distance ``r`` of each other. Pivots cut the vectors of a
label into cells (nearest pivot). By the triangle inequality, a vector of cell p can only have a partner in cell q if it is
at most ``2 r`` further from q than from p, and, as the space is Euclidean, at most ``r`` from the plane between them; it is
copied to just those cells, and to the later of two cells only, so that every pair meets once. Cells are joined
independently, in pairs of blocks of at most about ``BLOCK`` vectors.

Equal vectors of a label are one vector with a number of copies. A task gives, for each vector, the sum of its links, and
a forest of the links, never the pairs. Pivots come from a sample and steer the work only: any pivots give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.graph import components, forest
from quire.llm.tables import column, settled, table

THRESHOLD = 0.98
BLOCK = 1024
PIVOTS = 2048  # of all labels together, at most


def _units(rows: DataFrame) -> DataFrame:
    """(id, label, dim, vec) of rows (id, label, e): unit vectors as little-endian doubles; null if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            out = []
            for i in range(len(batch)):
                values = lists[i].values if lists[i].is_valid else None
                unit = None
                if values is not None and len(values) and not values.null_count:
                    v = values.to_numpy(zero_copy_only=False).astype("<f8")
                    if np.isfinite(v).all() and v.any():
                        v = v / np.abs(v).max()  # no overflow in the norm
                        unit = (v / np.linalg.norm(v) + 0.0).tobytes()
                out.append(unit)
            dim = pa.array([None if u is None else len(u) // 8 for u in out], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), dim, pa.array(out, pa.binary())], names=["id", "label", "dim", "vec"])

    return rows.mapInArrow(run, "id long, label string, dim int, vec binary")


def _pivots(classes: DataFrame, radius: float) -> dict[tuple[str, int], np.ndarray]:
    """A few vectors of each large label; at most about ``PIVOTS`` reach the driver."""
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = F.least(F.col("n") / BLOCK, F.lit(float(PIVOTS)) * F.col("n") / F.lit(float(max(total, 1))))
    large = sizes.withColumn("p", F.floor(share)).where("p >= 2")
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("p") / F.col("n") * float(1 << 30)
    rows = classes.join(large, ["label", "dim"]).where(chosen).select("label", "dim", "vec").collect()
    found: dict[tuple[str, int], list[np.ndarray]] = {}
    for r in sorted(rows, key=lambda r: (r["label"], r["dim"], bytes(r["vec"]))):
        v = np.frombuffer(r["vec"], "<f8")
        others = found.setdefault((r["label"], r["dim"]), [])
        if all(np.linalg.norm(v - o) > 2 * radius for o in others):  # pivots that are near each other only add copies
            others.append(v)
    return {k: np.array(v) for k, v in found.items()}


def _cells(classes: DataFrame, pivots: dict[tuple[str, int], np.ndarray], radius: float) -> DataFrame:
    """Every vector in its own cell, and copies in the later cells that may hold partners."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    slack = 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            groups: dict[tuple[str, int], list[int]] = {}
            for i, k in enumerate(zip(label, dim, strict=True)):
                groups.setdefault(k, []).append(i)
            rows, cells, own = [], [], []
            for key, at in groups.items():
                p = shared.value.get(key)
                at = np.array(at)
                if p is None:
                    rows.append(at)
                    cells.append(np.zeros(len(at), np.int64))
                    own.append(np.ones(len(at), bool))
                    continue
                x = np.frombuffer(b"".join(batch.column("vec")[int(i)].as_py() for i in at), "<f8").reshape(len(at), -1)
                square = np.maximum(2 - 2 * (x @ p.T), 0)
                d, between = np.sqrt(square), np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
                home = np.argmin(d, axis=1)
                near = np.arange(len(at))
                further = d - d[near, home][:, None] <= 2 * radius + slack
                plane = square - square[near, home][:, None] <= 2 * radius * between[home] + slack
                later = np.arange(len(p))[None, :] > home[:, None]
                keep = further & plane & later
                keep[near, home] = True
                i, c = np.nonzero(keep)
                rows.append(at[i])
                cells.append(c)
                own.append(c == home[i])
            if rows:
                out = batch.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cells)), pa.array(np.concatenate(own))], names=[*out.schema.names, "cell", "own"])

    return settled(classes.mapInArrow(run, "id long, label string, dim int, vec binary, copies long, cell long, own boolean"))


def _joined(cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): sums of links of vectors a; and links (a, b) that join up all that are linked."""
    key = ["label", "dim", "cell"]
    sizes = cells.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = (
        cells.join(sizes, key)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "vec", "copies", "own")
    )

    def join(keys: tuple, group: pa.Table) -> pa.Table:
        i, j = keys[3].as_py(), keys[4].as_py()
        ids, copies, own, block = (group.column(c).to_numpy() for c in ("id", "copies", "own", "block"))
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), "<f8").reshape(len(ids), -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        link = x[left] @ x[right].T >= threshold
        link &= own[left][:, None] | own[right][None, :]
        if i == j:
            np.fill_diagonal(link, False)
        links = np.zeros(len(ids), np.int64)
        links[left] += link @ copies[right]
        if i != j:
            links[right] += link.T @ copies[left]
        p, q = np.nonzero(np.triu(link) if i == j else link)
        a, b = forest(ids[left[p]], ids[right[q]])
        some = links > 0
        return pa.table({
            "a": np.concatenate([ids[some], a]),
            "b": pa.array(np.concatenate([np.zeros(some.sum(), np.int64), b]), mask=np.arange(some.sum() + len(b)) < some.sum()),
            "links": np.concatenate([links[some], np.zeros(len(a), np.int64)]),
        })

    return settled(dealt.groupBy(*key, "i", "j").applyInArrow(join, "a long, b long, links long"))


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link when their labels are equal and their cosine, in double precision, is at least ``threshold``. Null and
    zero vectors, those with null or non-finite components, and rows without a label link with nothing, nor do vectors of
    different lengths. Equal vectors link with each other. Rows with a null id link with nothing, and have a null
    component and ``kept``. Repeated rows count as other vectors each. Other columns are ignored.
    """
    radius = float(np.sqrt(2 - 2 * threshold))
    source = vectors.select(column(vec_id).cast("long").alias("id"), column(label).cast("string").alias("label"), column(embedding).alias("e"))
    rows = settled(_units(source).withColumn("code", F.when(F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("vec").isNotNull(), F.md5("vec"))))
    classes = settled(
        rows.where("code is not null").groupBy("label", "code").agg(F.min("id").alias("id"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"))
    )
    plain = classes.select("id", "label", "dim", "vec", "copies")
    found = _joined(_cells(plain, _pivots(plain, radius), radius), threshold)
    degrees = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"))
    named = classes.select("label", "code", F.col("id").alias("a"), "copies").join(degrees, "a", "left").join(groups.withColumnRenamed("node", "a"), "a", "left")
    named = settled(named.select("label", "code", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "a").alias("component")))
    out = rows.select("id", "label", "code").join(named, ["label", "code"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op6_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = {
    "op6_metric_join": """
with recursive v as (select vec_id, label, cast(embedding as double[]) e from embeddings where label is not null),
links as (select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  and list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x, min(y) m from reach group by 1),
degree as (select x, count(*) n from links group by 1)
select vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(m, vec_id)) component_id, vec_id <= coalesce(m, vec_id) kept
from embeddings e left join degree d on vec_id = d.x left join least l on vec_id = l.x
"""
}
