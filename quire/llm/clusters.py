"""Centroid clustering of integer vectors with drift bounds that plane geometry tightens.

Every vector carries its cluster, an upper bound of the distance to its own centroid and a lower bound of the distance to
all others. When centroids move, the upper bound grows by the own centroid's drift. The lower bound need not fall by the full
drift of the others: all vectors of a cluster lie in a sphere, and how much nearer a moved centroid can come to a sphere
follows in the plane through the sphere's centre and the two places of that centroid, from the angle at which the sphere is
seen from halfway between them (``drift``). Where the bounds still part own and other centroids nothing is computed; the own
distance comes next, and only vectors that stay ambiguous are compared with all centroids, exactly, in whole numbers.

Vectors are written once, in blocks, bucketed by block. The state of a block (cluster and bounds, 17 bytes a vector) is a
bucketed table of its own each round, so that state and vectors meet without a shuffle, and rounds write the state only. A
round also gives, for each cluster, the sums of vectors that came and left: tasks add them up, and at most ``k`` rows a
dimension reach the driver. Sums, floors and distances are exact for components of any size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.tables import column, settled, table

K = 8
ROUNDS = 10
SEED = 3
DIMENSIONS = 64
SCALE = 1024
BLOCK = 1024  # vectors of a block: 256 KB
BUCKET = 1 << 20  # vectors of a bucket, about
BUCKETS = 50_000  # at most

_NARROW = 1 << 26  # components below are added and multiplied in 64 bits
_LONG = (1 << 63) - 1
_SLACK = 1e-9  # of rounding in bounds, relative
_ANGLE = 1e-7  # of rounding in angles


# --- geometry ---------------------------------------------------------------------


def drift(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """The most by which a point within ``radius`` of ``centre`` can be nearer to ``new`` than to ``old``.

    With p = \\|new - old\\| and the point x at the angle t, seen from halfway, to the direction of the move, \\|x - old\\| - \\|x - new\\|
    is at most p cos t. The sphere is seen at the angle of its centre, give or take asin(radius / distance).
    """
    way = new - old
    p = float(np.linalg.norm(way))
    if not np.isfinite(p):
        return np.inf
    if p == 0:
        return 0.0
    seen = centre - (old + new) / 2
    distance = float(np.linalg.norm(seen))
    if not radius < distance or not np.isfinite(distance):
        return p
    cosine = np.clip(float(seen @ way) / (p * distance), -1, 1)
    least = max(0.0, float(np.arccos(cosine)) - float(np.arcsin(radius / distance)))
    return p * min(1.0, max(0.0, float(np.cos(least))) + _ANGLE)


# --- exact arithmetic ----------------------------------------------------------------


def floored(value: float) -> int:
    """floor(1024 x), exactly, for any finite double."""
    scaled = value * SCALE
    return int(np.floor(scaled)) if np.isfinite(scaled) else int(value) * SCALE


def _distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of rows to centroids: int64 where that can't overflow, else Python's integers."""
    narrow = x.dtype != object and all(abs(v) <= _NARROW for c in centroids for v in c)
    out = []
    for c in centroids:
        d = (x.astype(np.int64) if narrow else x.astype(object)) - np.array(c, np.int64 if narrow else object)
        out.append(np.einsum("ij,ij->i", d, d) if narrow else (d * d).sum(axis=1))
    return np.stack(out, axis=1)


def _roots(squares: np.ndarray) -> np.ndarray:
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([float(v) ** 0.5 if v < 1 << 1000 else np.inf for v in squares.ravel()], np.float64).reshape(squares.shape)


class Step:
    """The centroids of a round, and how far each cluster's bounds are loosened since the round before."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None = None, radii: list[float] | None = None) -> None:
        self.centroids = centroids
        self.first = before is None
        if before is None:
            return
        now, then = (np.array([[float(v) if abs(v) < 1 << 1000 else np.inf for v in c] for c in cs]) for cs in (centroids, before))
        with np.errstate(all="ignore"):
            self.own = np.nan_to_num(np.linalg.norm(now - then, axis=1), nan=np.inf)
            others = [[drift(then[a], radii[a], then[j], now[j]) for j in range(len(now)) if j != a] for a in range(len(now))]
        self.others = np.array([max(o, default=0.0) for o in others])

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper, lower) of the vectors ``x`` after this step, and how many were compared with all centroids."""
        if self.first:
            scan = np.arange(len(x))
        else:
            upper = upper + self.own[cluster] * (1 + _SLACK)
            lower = lower - self.others[cluster]
            open_ = np.flatnonzero(~(upper < lower))
            upper[open_] = _roots(self.own_distance(x[open_], cluster[open_])) * (1 + _SLACK)
            scan = open_[~(upper[open_] < lower[open_])]
        if len(scan):
            squares = _distances(x[scan], self.centroids)
            best = np.array([int(np.argmin(row)) for row in squares]) if squares.dtype == object else np.argmin(squares, axis=1)
            roots = _roots(squares)
            at = np.arange(len(scan))
            cluster[scan], upper[scan] = best, roots[at, best] * (1 + _SLACK)
            roots[at, best] = np.inf
            lower[scan] = roots.min(axis=1) * (1 - _SLACK)
        return cluster, upper, lower, len(scan)

    def own_distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), object if x.dtype == object else np.int64)
        for c in np.unique(cluster):
            at = np.flatnonzero(cluster == c)
            found = _distances(x[at], [self.centroids[c]])[:, 0]
            out = out.astype(object) if found.dtype == object else out
            out[at] = found
        return out


# --- blocks ------------------------------------------------------------------------------


def _blocks(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(ids, x, wide, n): blocks of vectors as whole numbers; wide ones as text, since they fit no machine number."""

    def block(ids: list, x: np.ndarray, wide: bool) -> pa.RecordBatch:
        data = ";".join(",".join(map(str, r)) for r in x).encode() if wide else x.astype("<i4").tobytes()
        fields = [pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([wide]), pa.array([len(ids)], pa.int32())]
        return pa.RecordBatch.from_arrays(fields, names=["ids", "x", "wide", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            ids = batch.column("id").to_pylist()
            with np.errstate(over="ignore"):
                scaled = np.floor(values * SCALE)
            wide = (np.abs(scaled) > _NARROW).any(axis=1)
            for at in (np.flatnonzero(~wide), np.flatnonzero(wide)):
                for i in range(0, len(at), BLOCK):
                    some = at[i : i + BLOCK]
                    far = bool(wide[some[0]])
                    x = np.array([[floored(v) for v in row] for row in values[some].tolist()], object) if far else scaled[some]
                    yield block([ids[j] for j in some], x, far)

    return vectors.mapInArrow(run, "ids array<long>, x binary, wide boolean, n int")


def _vectors(data: bytes, wide: bool, dimensions: int) -> np.ndarray:
    if wide:
        return np.array([[int(v) for v in row.split(",")] for row in data.decode().split(";")], object)
    return np.frombuffer(data, "<i4").reshape(-1, dimensions)


def _limbs(cluster: int, dim: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    """A whole number in digits of 48 bits, each small enough to be added up exactly; dimension -1 counts vectors."""
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & ((1 << 48) - 1):
            yield cluster, dim, limb, sign * (value & ((1 << 48) - 1))
        value, limb = value >> 48, limb + 1


def _moved(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Sums of what came to each cluster less what left it, with counts: (as text for wide vectors, else as int64)."""
    changed = np.arange(len(new)) if old is None else np.flatnonzero(old != new)
    if not len(changed):
        return b"", b""
    kind = object if x.dtype == object else np.int64
    sums = np.zeros((k, x.shape[1] + 1), kind)
    part = np.concatenate([x[changed].astype(kind), np.ones((len(changed), 1), kind)], axis=1)
    for c in np.unique(new[changed]):
        sums[c] += part[new[changed] == c].sum(axis=0)
    if old is not None:
        for c in np.unique(old[changed]):
            sums[c] -= part[old[changed] == c].sum(axis=0)
    return (b"", sums.astype("<i8").tobytes()) if kind is np.int64 else (",".join(map(str, sums.ravel())).encode(), b"")


class _Tables:
    """Bucketed tables of one run: names that nobody else has; dropped at the end."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.run, self.names = spark, buckets, uuid.uuid4().hex[:12], []

    def write(self, rows: DataFrame) -> DataFrame:
        name = f"quire_clusters_{self.run}_{len(self.names)}"
        self.names.append(name)
        rows.write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(self.buckets, "block").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, keep: int = 0) -> None:
        """All tables but the last ``keep`` states; the vectors stay unless nothing is kept."""
        last = len(self.names) - keep
        for i, name in enumerate(self.names):
            if name and i < last and (i or not keep):
                self.spark.sql(f"drop table if exists {name}")
                self.names[i] = ""


def _round(blocks: DataFrame, state: DataFrame | None, step: Step, dimensions: int) -> DataFrame:
    """The next state of every block."""
    k, first = len(step.centroids), state is None
    rows = blocks.select("block", "x", "wide", "n")
    if not first:
        rows = rows.join(state.select("block", "cluster", "upper", "lower"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x = _vectors(batch.column("x")[i].as_py(), batch.column("wide")[i].as_py(), dimensions)
                old, upper, lower = None, np.zeros(len(x)), np.zeros(len(x))
                if not first:
                    old = np.frombuffer(batch.column("cluster")[i].as_py(), "<i4")
                    upper, lower = (np.frombuffer(batch.column(c)[i].as_py(), "<f8").copy() for c in ("upper", "lower"))
                new = np.zeros(len(x), "<i4") if first else old.copy()
                new, upper, lower, scanned = step.assign(x, new, upper, lower)
                wide, sums = _moved(x, old, new, k)
                radii = np.zeros(k)
                np.maximum.at(radii, new, upper)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("block").slice(i, 1),
                        *[pa.array([v], pa.binary()) for v in (new.astype("<i4").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes())],
                        pa.array([scanned], pa.int64()),
                        *[pa.array([v], pa.binary()) for v in (wide, sums, radii.astype("<f8").tobytes())],
                    ],
                    names=["block", "cluster", "upper", "lower", "scanned", "wide_sums", "sums", "radii"],
                )

    schema = "block long, cluster binary, upper binary, lower binary, scanned long, wide_sums binary, sums binary, radii binary"
    return rows.mapInArrow(run, schema)


def _totals(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, list[float], int]:
    """(sums of each cluster with counts last, radii, vectors scanned): added up by tasks, then by Spark."""
    width = dimensions + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, radii, scanned = np.zeros(k * width, object), np.zeros(k), 0
        for batch in batches:
            part = np.zeros(k * width, np.int64)
            for wide, sums, r, s in zip(*[batch.column(c).to_pylist() for c in ("wide_sums", "sums", "radii", "scanned")], strict=True):
                if sums:
                    part += np.frombuffer(sums, "<i8")
                if wide:
                    total += np.array([int(v) for v in wide.split(b",")], object)
                radii = np.maximum(radii, np.frombuffer(r, "<f8"))
                scanned += s
            total = total + part.astype(object)
        limbs = [x for i, v in enumerate(total.tolist()) for x in _limbs(i // width, i % width, v)]
        limbs.append((-1, 0, 0, scanned))
        cluster, dim, limb, value = zip(*limbs, strict=True)
        fields = [pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64()), pa.nulls(len(limbs), pa.float64())]
        yield pa.RecordBatch.from_arrays(fields, names=["cluster", "dim", "limb", "value", "radius"])
        fields = [pa.array(range(k), pa.int32()), *[pa.array([-2] * k, pa.int32())] * 2, pa.array([0] * k, pa.int64()), pa.array(radii)]
        yield pa.RecordBatch.from_arrays(fields, names=["cluster", "dim", "limb", "value", "radius"])

    parts = state.select("wide_sums", "sums", "radii", "scanned").mapInArrow(run, "cluster int, dim int, limb int, value long, radius double")
    sums, radii, scanned = np.zeros((k, width), object), [0.0] * k, 0
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"), F.max("radius").alias("radius")).collect():
        if r["dim"] == -2:
            radii[r["cluster"]] = r["radius"]
        elif r["cluster"] == -1:
            scanned = int(r["value"])
        else:
            sums[r["cluster"], r["dim"]] += int(r["value"]) << (48 * r["limb"])
    return sums, radii, scanned


def _starts(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The first ``k`` vectors by the hash of their ids; of equal ids the lesser vector comes first, null ids come last."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.select(code.alias("code"), "e").orderBy(F.asc_nulls_last("code"), "e").limit(k).collect()
    return [[floored(float(v)) for v in r["e"]] for r in rows]


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dimensions: int = DIMENSIONS,
    scans: list[int] | None = None,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors of ``dimensions`` components.

    Vectors that are null, of another length, or hold null or non-finite components are left out. Components become
    floor(1024 x). Centroids start as the ``k`` vectors (or as many as there are) of the least sha256 of ``seed:vec_id``. A
    round assigns every vector to the nearest centroid, of equally near ones the lesser number, and replaces each that has
    vectors by their floored mean; at the end vectors are assigned once more. ``distance`` is squared; distances and their
    sums that don't fit a long are given as the greatest long.

    Repeated rows and ids are vectors each; rows with a null id take part but start no cluster while others can. Other
    columns are ignored; no rows give none. ``scans`` is filled with the number of vectors compared exactly in each round.
    """
    spark = vectors.sparkSession
    e = F.transform(column(embedding), lambda v: v.cast("double"))
    fine = F.forall(F.col("e"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.select(column(vec_id).cast("long").alias("id"), e.alias("e")).where(F.size("e") == dimensions).where(fine)
    centroids = _starts(kept, k, seed)
    k = len(centroids)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = _Tables(spark, min(BUCKETS, max(-(-kept.count() // BUCKET), least)))
    numbered = _blocks(kept, dimensions).withColumn("block", F.monotonically_increasing_id())
    blocks = tables.write(numbered.repartition(tables.buckets, "block"))
    state, step = None, Step(centroids)
    sums = np.zeros((k, dimensions + 1), object)
    for _ in range(rounds if k else 0):
        state = tables.write(_round(blocks, state, step, dimensions))
        tables.drop(keep=1)
        change, radii, scanned = _totals(state, k, dimensions)
        if scans is not None:
            scans.append(scanned)
        sums = sums + change
        moved = [[int(v) // int(s[-1]) for v in s[:-1]] if s[-1] else c for s, c in zip(sums, centroids, strict=True)]
        centroids, step = moved, Step(moved, centroids, radii)
    last = step

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x = _vectors(batch.column("x")[i].as_py(), batch.column("wide")[i].as_py(), dimensions)
                found, upper, lower = np.zeros(len(x), "<i4"), np.zeros(len(x)), np.zeros(len(x))
                if "cluster" in batch.schema.names:
                    found = np.frombuffer(batch.column("cluster")[i].as_py(), "<i4").copy()
                    upper, lower = (np.frombuffer(batch.column(c)[i].as_py(), "<f8").copy() for c in ("upper", "lower"))
                found = last.assign(x, found, upper, lower)[0]
                distance = [min(int(v), _LONG) for v in last.own_distance(x, found)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(found, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    rows = blocks.select("block", "ids", "x", "wide")
    rows = rows if state is None else rows.join(state.select("block", "cluster", "upper", "lower"), "block")
    out = settled(rows.mapInArrow(final, "vec_id long, cluster int, distance long"))
    tables.drop()
    inertia = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    each = F.array(*[F.lit(min(inertia.get(c, 0), _LONG)).cast("long") for c in range(k)]) if k else F.array().cast("array<long>")
    codes = F.array(*[F.lit(sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]).cast("array<string>")
    total = F.lit(min(sum(inertia.values()), _LONG)).cast("long")
    return out.select("vec_id", "cluster", "distance", F.get(each, F.col("cluster")).alias("cluster_inertia"), total.alias("inertia"), F.get(codes, F.col("cluster")).alias("centroid_sha256"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds one after the other; every step is whole numbers."""
    parts = [
        f"v as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) q from embeddings "
        f"where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as (select row_number() over (order by sha256('{SEED}:' || vec_id), q) - 1 c, q from v qualify c < {K})",
    ]
    for i in range(ROUNDS + 1):
        square = f"list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
        parts.append(f"d{i} as materialized (select r, vec_id, v.q q, c, {square} d from v, c{i} c qualify row_number() over (partition by r order by d, c) = 1)")
        if i < ROUNDS:
            parts.append(f"s{i} as (select c, i, cast(sum(x) as hugeint) s, count(*) n from (select c, unnest(range(1, {DIMENSIONS + 1})) i, unnest(q) x from d{i}) group by c, i)")
            floor = "cast((s - ((s % n) + n) % n) // n as bigint)"
            parts.append(f"c{i + 1} as materialized (select c{i}.c, coalesce(m.q, c{i}.q) q from c{i} left join (select c, list({floor} order by i) q from s{i} group by c) m on m.c = c{i}.c)")
    return (
        "with " + ",\n".join(parts) + f"\nselect vec_id, cast(d.c as int) \"cluster\", cast(d as bigint) distance, cast(sum(d) over (partition by d.c) as bigint) cluster_inertia, "
        f"cast(sum(d) over () as bigint) inertia, sha256(array_to_string(c{ROUNDS}.q, ',')) centroid_sha256 from d{ROUNDS} d join c{ROUNDS} on d.c = c{ROUNDS}.c"
    )


SQL = {"op11_clusters": _sql()}
