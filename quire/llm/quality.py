"""Quality classification by random-indexing word vectors and a small neural network.

Every word, and every word shape (case, digits, marks, length), falls into one of ``SLOTS`` hashed slots with a sparse
random index vector. A slot's word vector is the sum of the index vectors of the words around it, over all documents;
tasks sum their own before one row per slot is shuffled. A document is the mean and deviation of its words' and shapes'
vectors, rare ones weighing more, and a few figures of its form. A two-layer network is fitted on at most about
``SAMPLE`` labelled rows, and its temperature on a part of them that it didn't learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.language import remainder
from quire.llm.tables import column, settled, table
from quire.llm.words import SPACED, Texts, distinct, mix, slices, texts_of, words

WORD_SLOTS, SHAPE_SLOTS = 1 << 14, 1 << 10
SLOTS = WORD_SLOTS + SHAPE_SLOTS
WIDTH = 32
NONZERO = 2
REACH = 2  # words on either side
SAMPLE = 20_000
HIDDEN = 24
CUT = 0.3

_slot = np.arange(SLOTS, dtype=np.uint64)
_PLACE = np.stack([(mix(_slot, 20 + k) % np.uint64(WIDTH)).astype(np.int64) for k in range(NONZERO)])
_SIGN = np.stack([np.where(mix(_slot, 30 + k) & np.uint64(1), 1, -1) for k in range(NONZERO)])

_KIND = np.full(256, 3, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 mark; beyond ASCII counts as lower
_KIND[0x61:0x7B] = 0
_KIND[0x80:] = 0
_KIND[0x41:0x5B] = 1
_KIND[0x30:0x3A] = 2


def slots(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word slot and shape slot of every word, the bounds of the texts, and the words' codes."""
    found = words(texts, SPACED)
    if not len(found.code):
        none = np.zeros(0, np.int64)
        return none, none, found.bounds, found.code
    shape = np.zeros(len(found.code), np.int64)
    kinds = _KIND[texts.data]
    for k in range(4):
        seen = np.concatenate([[0], np.cumsum(kinds == k)])
        shape = shape * 3 + np.minimum(seen[found.end] - seen[found.start], 2)
    length = np.minimum(np.log2(found.end - found.start).astype(np.int64), 6)
    last = texts.data[found.end - 1].astype(np.int64)
    last = np.where(_KIND[last] == 3, last, 0)
    shape = ((shape * 4 + kinds[found.start]) * 8 + length) * 256 + last
    word = (found.code % np.uint64(WORD_SLOTS)).astype(np.int64)
    return word, WORD_SLOTS + (mix(shape.astype(np.uint64), 13) % np.uint64(SHAPE_SLOTS)).astype(np.int64), found.bounds, found.code


def _neighbours(slot: np.ndarray, text: np.ndarray, total: np.ndarray) -> None:
    """Add the index vectors of the slots around each slot to its sum."""
    places, signs = [], []
    for step in range(1, REACH + 1):
        same = text[step:] == text[:-step]
        a, b = slot[:-step][same], slot[step:][same]
        for own, other in ((a, b), (b, a)):
            places += [own * WIDTH + _PLACE[k][other] for k in range(NONZERO)]
            signs += [_SIGN[k][other] for k in range(NONZERO)]
    total += np.bincount(np.concatenate(places), np.concatenate(signs), minlength=SLOTS * WIDTH).astype(np.int64)


def word_vectors(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of all slots, their weights), from all documents; ``SLOTS`` rows reach the driver."""
    source = docs.select(column(text).cast("string").alias("t"))
    names = ["slot", "n", *(f"d{i}" for i in range(WIDTH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(SLOTS * WIDTH, np.int64), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, part in slices(texts_of(batch.column(0))):
                word, shape, bounds, _ = slots(part)
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for slot in (word, shape):
                    _neighbours(slot, owner, total)
                    count += np.bincount(slot, minlength=SLOTS)
        seen = np.flatnonzero(count)
        columns = [seen, count[seen], *total.reshape(SLOTS, WIDTH)[seen].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    rows = source.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    summed = rows.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()
    vectors, count = np.zeros((SLOTS, WIDTH)), np.zeros(SLOTS)
    for r in summed:
        count[r[0]], vectors[r[0]] = r[1], r[2:]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    share = count / max(count.sum(), 1)
    return vectors, 1e-3 / (1e-3 + share)


def pooling_table(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What each slot adds to a text's sums: its weighted vector, that of its squares, and its weight."""
    w = weights[:, None]
    return np.concatenate([vectors * w, vectors**2 * w, w], axis=1).astype(np.float32)


def features(texts: Texts, pooling: np.ndarray) -> np.ndarray:
    """One row for each text: pooled words, pooled shapes, and its form."""
    word, shape, bounds, code = slots(texts)
    n = np.diff(bounds)
    some, out = n > 0, []
    for slot in (word, shape):
        sums = np.zeros((len(n), 2 * WIDTH + 1), np.float32)
        if len(slot):
            sums[some] = np.add.reduceat(pooling[slot], bounds[:-1][some], axis=0)
        mean, square = (sums[:, k * WIDTH : (k + 1) * WIDTH] / np.maximum(sums[:, -1:], 1e-9) for k in (0, 1))
        out += [mean, np.sqrt(np.maximum(square - mean**2, 0))]
    different = np.diff(distinct(code, bounds)[1])
    size = np.diff(texts.offsets)
    lines = np.concatenate([[0], np.cumsum(texts.data == 10)])[texts.offsets]
    marks = np.concatenate([[0], np.cumsum(_KIND[texts.data] == 3)])[texts.offsets]
    form = [np.log1p(n), different / np.maximum(n, 1), size / np.maximum(n, 1), np.diff(lines) / np.maximum(n, 1), np.diff(marks) / np.maximum(size, 1)]
    return np.concatenate([*out, np.stack(form, axis=1)], axis=1).astype("<f4")


class Network:
    """Two layers, fitted by Adam on standardised features; probabilities are divided by a temperature first."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = x.mean(axis=0), x.std(axis=0) + 1e-6, 1.0
        x = self._ready(x)
        held = rng.random(len(x)) < 0.2
        if held.all() or not held.any():
            held[:] = False
        size = x.shape[1]
        p = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        moments = [(np.zeros_like(v), np.zeros_like(v)) for v in p]
        self.p, step = p, 0
        learn = np.flatnonzero(~held)
        for _ in range(rounds):
            for at in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
                hidden = np.tanh(x[at] @ p[0] + p[1])
                miss = (_probability(hidden @ p[2] + p[3]) - y[at]) / len(at)
                back = miss[:, None] * p[2] * (1 - hidden**2)
                slopes = [x[at].T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ miss + 1e-4 * p[2], np.array([miss.sum()])]
                step += 1
                for v, g, (m, s) in zip(p, slopes, moments, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        if held.any():
            logit, truth = self._logit(x[held]), y[held]
            loss = {t: -np.mean(np.log(np.where(truth == 1, _probability(logit / t), 1 - _probability(logit / t)) + 1e-12)) for t in np.geomspace(0.25, 8, 41)}
            self.temperature = min(loss, key=loss.get)

    def _ready(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _probability(self._logit(self._ready(x)) / self.temperature)


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def score(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of every row: the probability that the label is 1.

    ``learn`` says, of a row of ``labels``, whether to learn from it; null labels and ids are left out, repeated rows count
    each. Null and empty texts are scored as texts without words. Without rows to learn from, every score is 0.5, and if all
    have one label, that label. Very long texts count whole; an empty table gives no rows; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(pooling_table(*word_vectors(docs, text)))  # of fixed size
    source = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(texts_of(batch.column(1)), 1 << 20):
                x = features(part, model.value)
                rows = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), rows], names=["doc_id", "x"])

    pool = settled(source.mapInArrow(pooled, f"doc_id {kind}, x binary"))
    usable = labels.where(learn).select(column(doc_id).alias("doc_id"), column(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    n = usable.count()
    share = min(1.0, sample / max(n, 1))
    picked = settled(usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < share * float(1 << 30)))
    rows = pool.join(picked, "doc_id").select("doc_id", "x", "y").collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["y"], bytes(r["x"])))
    y = np.array([r["y"] for r in rows], float)
    if len(rows) and 0 < y.mean() < 1:
        net = Network(np.array([np.frombuffer(r["x"], "<f4") for r in rows], float), y)
    else:
        net = None
    constant = float(y.mean()) if len(rows) else 0.5

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<f4").reshape(len(batch), -1)
            p = net.probability(x.astype(float)) if net and len(batch) else np.full(len(batch), constant)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return pool.mapInArrow(scored, f"doc_id {kind}, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
