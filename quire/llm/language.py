"""Language identification by the nearest of several centroids per language.

A text is a normalised TF-IDF vector of hashed byte n-grams. Document frequencies are counted over all rows to learn
from; centroids come from spherical k-means on a sample of at most about ``SAMPLE`` rows a language, chosen by a hash of
the row, one language in each task. A text takes the language of the centroid with the greatest cosine, and is rejected
where that cosine is far below what the learned texts of the language reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.tables import column, extended, fresh, settled, table
from quire.llm.words import Texts, mix, slices, texts_of

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE = 600
#: A text is rejected below this share of the cosine that 199 of 200 learned texts of the language exceed.
REJECT = 0.25
UNKNOWN = "und"
PORTION_BYTES = 1 << 18
PORTION_TEXTS = 256

_FOLD = np.full(256, 0x20, np.uint8)  # what isn't a letter separates words
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = _FOLD < 0x80
_LETTER &= _FOLD != 0x20
_SALTS = (7, 8)


def portions(texts: Texts) -> Iterator[tuple[int, int, Texts]]:
    """Slices of few bytes and few texts: each byte takes some 100 bytes on the way to ``counts``, and each text several rows of them."""
    for first, last, part in slices(texts, PORTION_BYTES):
        for at in range(first, last, PORTION_TEXTS):
            end = min(last, at + PORTION_TEXTS)
            start, stop = part.offsets[at - first], part.offsets[end - first]
            yield at, end, Texts(part.data[start:stop], part.offsets[at - first : end - first + 1] - start)


def counts(texts: Texts) -> np.ndarray:
    """Counts of hashed pairs and triples of bytes, one row per text."""
    n = len(texts)
    data = _FOLD[texts.data].astype(np.uint64)
    owner = np.repeat(np.arange(n), np.diff(texts.offsets))
    out = np.zeros(n * DIMENSIONS, np.float32)
    for size, salt in zip((2, 3), _SALTS, strict=True):
        if len(data) < size:
            continue
        code = np.zeros(len(data) - size + 1, np.uint64)
        blank = np.zeros(len(code), bool)
        for k in range(size):
            part = data[k : len(data) - size + 1 + k]
            code = code * np.uint64(256) + part
            blank |= (part == 0x20) if k and k < size - 1 else False
        pure = (owner[: len(code)] == owner[size - 1 :]) & ~blank
        slot = (mix(code[pure], salt) % np.uint64(DIMENSIONS)).astype(np.int64)
        out += np.bincount(owner[: len(code)][pure] * DIMENSIONS + slot, minlength=len(out)).astype(np.float32)
    return out.reshape(n, DIMENSIONS)


def lettered(texts: Texts) -> np.ndarray:
    """Which texts hold a letter."""
    seen = np.concatenate([[0], np.cumsum(_LETTER[texts.data])])[texts.offsets]
    out = seen[1:] > seen[:-1]
    wide = np.concatenate([[0], np.cumsum(texts.data >= 0x80)])[texts.offsets]
    for i in np.flatnonzero(~out & (wide[1:] > wide[:-1])):
        raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
        out[i] = any(c.isalpha() for c in raw.decode("utf-8", "ignore"))
    return out


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors; texts without any known n-gram stay zero."""
    out = np.log1p(tf) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun from rows that are far from one another."""
    chosen = [0]
    near = rows @ rows[0]
    for _ in range(1, min(k, len(rows))):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centers = rows[chosen]
    for _ in range(rounds):
        own = np.argmax(rows @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.maximum(size, 1e-12), centers)
    return centers


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram occurs, and the number of texts; one row per n-gram and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for batch in batches:
            for first, last, part in portions(texts_of(batch.column(0))):
                total[:-1] += (counts(part) > 0).sum(axis=0)
                n += last - first
        total[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(total)], names=["f", "n"])

    summed = rows.select("t").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS + 1, np.int64)
    for r in summed:
        df[r["f"]] = r["n"]
    return df[:-1], int(df[-1])


class Model:
    """Centroids, their languages and least cosines."""

    def __init__(self, idf: np.ndarray, centers: np.ndarray, langs: list[str], least: np.ndarray):
        self.idf, self.centers, self.langs, self.least = idf, centers, np.array(langs, object), least

    def predict(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, cosine, and whether it is rejected."""
        known = lettered(texts)
        lang = np.full(len(texts), UNKNOWN, object)
        score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        if len(self.langs):
            cosine = weighted(counts(texts), self.idf) @ self.centers.T
            best = np.argmax(cosine, axis=1)
            value = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
            lang[known], score[known] = self.langs[best[known]], value[known]
            rejected = ~known | (value < self.least[best])
        return lang, score, rejected


def fit(rows: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, reject: float = REJECT) -> Model:
    """Learn from columns ``t`` (text) and ``lang``, neither null; ``h`` is a hash of the row, evenly spread over longs."""
    df, n = _frequencies(rows)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row for each language
    share = F.create_map(*[x for r in sizes.collect() for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["n"])))]) if n else None
    if share is None:
        return Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    picked = F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)
    chosen = settled(rows.where(picked).select("lang", "h", "t"))

    def cluster(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("t", "ascending")])
        vectors = np.concatenate([weighted(counts(part), idf) for _, _, part in portions(texts_of(group.column("t")))])
        vectors = vectors[np.linalg.norm(vectors, axis=1) > 0.5]
        if not len(vectors):
            return pa.table({"lang": pa.array([], pa.string()), "c": pa.array([], pa.binary()), "least": pa.array([], pa.float64())})
        centers = kmeans(vectors, centroids).astype(np.float32)
        least = reject * float(np.quantile((vectors @ centers.T).max(axis=1), 0.005))
        return pa.table({"lang": [key[0].as_py()] * len(centers), "c": [c.tobytes() for c in centers], "least": [least] * len(centers)})

    found = chosen.groupBy("lang").applyInArrow(cluster, "lang string, c binary, least double").collect()
    found.sort(key=lambda r: (r["lang"], r["c"]))
    centers = np.array([np.frombuffer(r["c"], np.float32) for r in found], np.float32).reshape(-1, DIMENSIONS)
    langs = [r["lang"] for r in found]
    keep = _own(chosen, idf, centers, langs)
    return Model(idf, centers[keep], [langs[i] for i in keep], np.array([found[i]["least"] for i in keep]))


def _own(chosen: DataFrame, idf: np.ndarray, centers: np.ndarray, langs: list[str]) -> list[int]:
    """Centroids that mostly attract their own language; of a language without any, the one that does so most.

    A passage in one language that texts labelled with another share would else become a centroid of the other one.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in portions(texts_of(batch.column("t"))):
                best = np.argmax(weighted(counts(part), idf) @ centers.T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(best), batch.column("lang").slice(first, last - first)], names=["c", "lang"])

    seen = chosen.select("lang", "t").mapInArrow(nearest, "c long, lang string").groupBy("c", "lang").count().collect()
    own, all_ = np.zeros(len(langs)), np.full(len(langs), 1e-9)
    for r in seen:
        all_[r["c"]] += r["count"]
        own[r["c"]] += r["count"] * (langs[r["c"]] == r["lang"])
    pure = own / all_
    best = {lang: max((i for i, x in enumerate(langs) if x == lang), key=lambda i: pure[i]) for lang in set(langs)}
    return [i for i, lang in enumerate(langs) if pure[i] > 0.5 or best[lang] == i]


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", learn: Column | None = None, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Learns from the rows where ``learn`` holds and text and language aren't null. Null texts and texts without a letter
    are ``und``, score 0, rejected; without rows to learn from, all texts are. Very long texts count whole; repeated rows
    count each; equal cosines go to the language that is first by name. New columns replace any of their names.
    """
    usable = column(text).isNotNull() & column(lang).isNotNull() & (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False)))
    h = F.xxhash64(F.coalesce(column(key).cast("string"), F.lit("")), F.length(column(text)))
    model = fit(docs.where(usable).select(column(text).cast("string").alias("t"), column(lang).cast("string").alias("lang"), h.alias("h")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors for each language

    def compute(batch: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for first, last, part in portions(texts_of(batch)):
            found, score, rejected = shared.value.predict(part)
            yield first, last, [pa.array(found.tolist(), pa.string()), pa.array(score), pa.array(rejected)]

    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    return extended(docs, text, fields, compute)


def known(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    n = fresh(docs, "row_columns")
    packed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias(n), "doc_id", "text", "lang")
    found = identify(packed, learn=remainder(F.col("doc_id"), 3) != 1)
    return found.where(~F.col("rejected")).select(*[column(n).getField(c).alias(c) for c in docs.columns])


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = remainder(F.col("doc_id"), 3)
    found = identify(docs, learn=part != 1)
    return found.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
