"""Repeated paragraphs: MinHash bands of word shingles, exact verification, and clusters by components.

``repeated`` compares lines, ``passages`` sentences wherever lines end, and joins adjacent repeated ones to passages.

Lines: a paragraph is a line. Lines of fewer than ``MIN_WORDS`` words, which hold no whole shingle, are left alone. Lines with equal sets of five-word shingles
share a key and need no comparison. The others meet where all rows of a band of MinHash values agree; the number of bands
is tuned so that of two lines at the threshold at least ``RECALL`` meet. In a bucket each line is compared with the least
one, by exact Jaccard similarity, and where that fails with those that links leave apart, as in the join of whole documents.
Links are joined up. Buckets are pre-aggregated in every batch.

Sentences: a unit ends with a sentence or a blank line; what is longer than ``LONG`` words is cut at words that its content
chooses, so equal passages have equal units whatever is around them and however they are wrapped. All units are compared,
those of fewer than five words as one sequence. Each of the ``n // 5 + 1`` least MinHash values of a set of ``n`` shingles is a
band of its own: sets at the threshold share one of them for certain, and sets of fewer than 4 link with equal ones only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.jaccard import SHINGLE, _starred, joined_up, linked, set_keys, shingle_sets, sketches
from quire.llm.tables import column, fresh, settled, table
from quire.llm.words import SPACED, Texts, Words, distinct, mix, runs, slices, texts_of, window_codes, words

MIN_WORDS = 5
ROWS = 2
RECALL = 0.9995
SIMILARITY = 0.8
LONG = 32  # words of a unit beyond which its content chooses where it is cut
CUT = 8  # one word in so many ends a unit there
PASSAGE = 40  # words that adjacent repeated units must have together
PORTION = 512  # pairs of sets that a task compares at a time
FIELD = 1 << 28  # bits of the field of keys to be compared, at most
PAGE = 1 << 15  # bits of a page of it, as many as a bitmap of Spark has

_MARKS, _CLOSERS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b".!?", b"\"')]"))
_LEAST = 4  # smaller sets link with none but equal ones


def bands(rows: int = ROWS, recall: float = RECALL, similarity: float = SIMILARITY) -> int:
    """The least number of bands by which lines of that similarity meet with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def lines(texts: Texts) -> tuple[Texts, np.ndarray]:
    """The lines of the texts, without their ends, as texts of their own; and the text of each."""
    breaks = np.flatnonzero(texts.data == 10) + 1
    offsets = np.unique(np.concatenate([texts.offsets, breaks]))
    owner = np.searchsorted(texts.offsets, offsets[:-1], "right") - 1
    return Texts(texts.data, offsets), owner


def _long(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, Texts, np.ndarray]:
    """(shingles, bounds, which lines are long enough, lines, owner) of some texts."""
    rows, owner = lines(part)
    values, bounds = shingle_sets(rows)
    return values, bounds, words(rows, SPACED).counts >= MIN_WORDS, rows, owner


def _paragraphs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, start, end, key, n, sketch) of the lines that are long enough, in code points."""
    source = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("t")).where("doc_id is not null")
    added = [*(T.StructField(n, T.LongType()) for n in ("start", "end", "key", "n")), T.StructField("sketch", T.BinaryType())]
    schema = T.StructType([source.schema[0], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(texts_of(batch.column(1))):
                values, bounds, keep, rows, owner = _long(part)
                points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
                at = np.flatnonzero(keep)
                origin = points[part.offsets[owner[at]]]
                stop = rows.offsets[at + 1]
                stop = np.where(part.data[stop - 1] == 10, stop - 1, stop) if len(at) else stop
                ids = batch.column(0).slice(first, last - first).take(pa.array(owner[at]))
                columns = [points[rows.offsets[at]] - origin, points[stop] - origin, set_keys(values, bounds)[at], np.diff(bounds)[at]]
                sketch = sketches(values, bounds).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns), sketch], names=schema.names)

    return settled(source.mapInArrow(run, schema))


def _bucketed(sigs: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
    """(sig, a, b) of a batch: each key of a signature beside the least one, whose own b is null."""
    sig = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)
    key = np.concatenate(keys) if keys else sig
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[new], key[new]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    least = key[np.flatnonzero(head)][np.cumsum(head) - 1] if len(sig) else key
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(least), pa.array(key, mask=head)], names=["sig", "a", "b"])


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    """(sig, a, b): lines that agree in a band; b is to be compared with a."""
    source = docs.select(column(text).cast("string").alias("t"))
    n = bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, keys = [], []
            for _, _, part in slices(texts_of(batch.column(0))):
                values, bounds, keep, _, _ = _long(part)
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                key = set_keys(values, bounds)[at]
                _, one = np.unique(key, return_index=True)
                at, key = at[one], key[one]
                size = bounds[at + 1] - bounds[at]
                item = values[np.repeat(bounds[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                heads = np.cumsum(size) - size
                for band in range(n):
                    code = np.full(len(at), band, np.uint64)
                    for row in range(ROWS):
                        code = mix(code + np.minimum.reduceat(mix(item, 40 + band * ROWS + row), heads), 2)
                    sigs.append(code)
                    keys.append(key)
            yield _bucketed(sigs, keys)

    rows = source.mapInArrow(run, "sig long, a long, b long")
    return rows.repartition("sig").sortWithinPartitions("sig", "a").mapInArrow(_starred, "sig long, a long, b long")


def _links(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, found: DataFrame) -> DataFrame:
    """Those of the pairs of lines that are similar; their documents are read again."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    places = settled(found.join(needed, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    source = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("t"))
    source = source.join(places.select("doc_id").distinct(), "doc_id", "left_semi").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in slices(texts_of(batch.column(0))):
                values, bounds, keep, _, _ = _long(part)
                sets = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(values.tobytes())])
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(values, bounds)).filter(mask), sets.filter(mask)], names=["key", "items"])

    sets = settled(source.mapInArrow(run, "key long, items binary").join(places.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    return _compared(pairs, sets)


def _numbers(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit numbers of binary values, and the bounds of each value's."""
    items = items.cast(pa.large_binary())  # which may have another offset
    _, offsets, data = items.buffers()
    edges = np.frombuffer(offsets, np.int64)[items.offset : items.offset + len(items) + 1] if len(items) else np.zeros(1, np.int64)
    found = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]].view(np.uint64) if edges[-1] > edges[0] else np.zeros(0, np.uint64)
    return found, (edges - edges[0]) // 8


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets (key, items) are similar enough."""
    joined = pairs.join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [pa.array([], pa.bool_())]
            for first in range(0, len(batch), PORTION):
                rows = batch.slice(first, PORTION)
                (x, ex), (y, ey) = _numbers(rows.column("x")), _numbers(rows.column("y"))
                both, nx, ny = np.empty(len(x) + len(y), np.uint64), np.diff(ex), np.diff(ey)
                both[np.arange(len(x)) + np.repeat(ey[:-1], nx)] = x
                both[np.arange(len(y)) + np.repeat(ex[1:], ny)] = y
                ok.append(pa.array(linked(nx + ny - np.diff(distinct(both, ex + ey)[1]), nx, ny)))
            mask = pa.concat_arrays(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return settled(joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(component_id, doc_id, start, end, kept): every line that stands, or nearly stands, elsewhere too.

    Positions are code points. ``component_id`` is the least doc_id of the cluster; ``kept`` marks the cluster's first
    line by doc_id and place, the others are to be removed. A line repeated within one document counts. Null, empty and
    short-lined texts and rows with a null doc_id have no rows here. Rows that share a doc_id and text share their places, so
    the kept line is kept in each of them. An empty table gives none; other columns are ignored. Texts are compared whole.
    """
    found = _paragraphs(docs, doc_id, text)
    known = settled(found.groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    usable = docs.where(column(doc_id).isNotNull())
    groups = settled(joined_up(settled(_candidates(usable, text)), known, lambda pairs: _links(pairs, usable, doc_id, text, found)))
    named = found.select("doc_id", "start", "end", "key").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("cluster", F.coalesce("component", "key"))
    place = F.struct("doc_id", "start")
    sizes = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    out = named.join(sizes, "cluster")
    return out.select(F.col("first.doc_id").alias("component_id"), "doc_id", "start", "end", (place == F.col("first")).alias("kept"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with all but the kept lines of each cluster taken out of their texts; other columns, of any name, stay.

    Null ids and texts stay as they are; repeated rows all stay, each with the lines that its doc_id keeps.
    """
    owner, lost = fresh(docs, "gone_id"), fresh(docs, "gone_lines")
    gone = repeated(docs, text, doc_id).where("not kept").groupBy(F.col("doc_id").alias(owner))
    gone = settled(gone.agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(lost)))
    joined = docs.join(gone, column(doc_id) == column(owner), "left")
    content = column(text)

    def step(done, s):
        piece = F.substring(content, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        return F.struct(F.concat(done["out"], piece).alias("out"), (s["end"] + 1).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    rest = F.aggregate(lost, start, step, lambda d: F.concat(d["out"], F.substring(content, (d["at"] + 1).cast("int"), F.length(content))))
    cleaned = F.when(column(lost).isNull(), content).otherwise(rest)
    return joined.select(*[cleaned.alias(c) if c == text else column(c) for c in docs.columns])


def units(texts: Texts) -> tuple[Words, np.ndarray]:
    """The words of the texts, and the bounds of their units: sentences, or parts of long ones."""
    found = words(texts, SPACED)
    n = len(found.start)
    if not n:
        return found, np.zeros(1, np.int64)
    last = texts.data[found.end - 1]
    closed = np.flatnonzero(_CLOSERS[last] & (found.end - found.start > 1))
    last[closed] = texts.data[found.end[closed] - 2]
    cut = _MARKS[last]
    breaks = np.searchsorted(np.flatnonzero(texts.data == 10), found.start)
    cut[:-1] |= np.diff(breaks) > 1
    cut[found.bounds[1:][found.bounds[1:] > 0] - 1] = True
    edges = np.concatenate([[0], np.flatnonzero(cut) + 1])
    size = np.diff(edges)
    cut |= np.repeat(size > LONG, size) & (found.code % np.uint64(CUT) == 0)
    return found, np.concatenate([[0], np.flatnonzero(cut) + 1])


def unit_sets(part: Texts) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, bounds of the units, shingles of each, their bounds) of some texts."""
    found, edges = units(part)
    first, length, per = runs(edges, SHINGLE)
    return found, edges, *distinct(window_codes(found.code, first, length, SHINGLE), per)


def _unit_candidates(docs: DataFrame, text: str) -> DataFrame:
    """(sig, a, b): units of different sets that share one of their least values; b is to be compared with a.

    And (null, key, count): sets that may stand more than once, whose counts, up to 2 a batch, are to be added up. Sets that
    link with equal ones only have a value of their own.
    """
    source = docs.select(column(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, keys, times = [], [], []
            for _, _, part in slices(texts_of(batch.column(0))):
                _, _, values, bounds = unit_sets(part)
                key, one, count = np.unique(set_keys(values, bounds), return_index=True, return_counts=True)
                size = np.diff(bounds)[one]
                n = np.where(size >= _LEAST, size // 5 + 1, 1)
                head = np.cumsum(n) - n
                # shingles are codes in ascending order, so the least values come first
                sig = values[np.repeat(bounds[one], n) + np.arange(n.sum()) - np.repeat(head, n)]
                sig[head[size < _LEAST]] = mix(key[size < _LEAST], 41)
                stands = np.zeros(len(sig), np.int32)  # counted at the first signature of a set
                stands[head] = np.minimum(count, 2)
                sigs.append(sig)
                keys.append(np.repeat(key, n))
                times.append(stands)
            yield _counted(sigs, keys, times)

    rows = source.mapInArrow(run, "sig long, key long, a long, times int")
    return settled(rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(_paired, "sig long, a long, b long"))


def _counted(sigs: list[np.ndarray], keys: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
    """(sig, key, a, times) of a batch: each key of a signature once, the least one as a, null in its own row."""
    sig = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)
    key, stands = (np.concatenate(x) if x else sig.astype(t) for x, t in ((keys, np.int64), (times, np.int32)))
    order = np.lexsort((key, sig))
    sig, key, stands = sig[order], key[order], stands[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    stands = np.minimum(np.add.reduceat(stands, np.flatnonzero(new)), 2) if len(sig) else stands
    sig, key = sig[new], key[new]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    least = key[np.flatnonzero(head)][np.cumsum(head) - 1] if len(sig) else key
    columns = [pa.array(sig), pa.array(key), pa.array(least, mask=head), pa.array(stands, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["sig", "key", "a", "times"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature: keys stay with the least of their batch of texts, those go to one of all; and counts of keys."""
    last = None  # signature of the row before, and the key that others of it go to
    for batch in batches:
        sig, key = batch.column("sig").to_numpy(), batch.column("key").to_numpy()
        if not len(sig):
            continue
        order = np.lexsort((key, sig))
        sig, key, times = sig[order], key[order], batch.column("times").to_numpy()[order]
        member = batch.column("a").is_valid().to_numpy(zero_copy_only=False)[order]
        a = batch.column("a").fill_null(0).to_numpy()[order]
        head = np.ones(len(sig), bool)
        head[1:] = sig[1:] != sig[:-1]
        again = np.zeros(len(sig), bool)
        again[1:] = ~head[1:] & (key[1:] == key[:-1])
        firsts = key[np.flatnonzero(head)]
        if last is not None and sig[0] == last[0]:
            firsts[0] = last[1]
        to = firsts[np.cumsum(head) - 1]
        last = sig[-1], to[-1]
        apart = ~member & (key != to) & ~again
        one = np.flatnonzero(~again)
        count = np.add.reduceat(times, one)
        # the signatures at the ends may go on in other batches
        told = (count > 1) | ((count > 0) & ((sig[one] == sig[0]) | (sig[one] == sig[-1])))
        pairs, counts = member.sum() + apart.sum(), told.sum()
        if not pairs + counts:
            continue
        of = pa.array(np.concatenate([sig[member], sig[apart], key[one][told]]), mask=np.arange(pairs + counts) >= pairs)
        x = np.concatenate([a[member], np.minimum(to, key)[apart], key[one][told]])
        y = np.concatenate([key[member], np.maximum(to, key)[apart], count[told]])
        yield pa.RecordBatch.from_arrays([of, pa.array(x), pa.array(y)], names=["sig", "a", "b"])


def _field(keys: DataFrame, size: int) -> bytes:
    """A bit for each of these keys: ``size`` bits or more, of which at most ``FIELD`` (32 MB) reach the driver, in pages."""
    bits = PAGE
    while bits < min(size, FIELD):
        bits *= 2
    coded = keys.select(F.pmod("key", F.lit(bits)).alias("code")).select(F.expr(f"code div {PAGE}").alias("page"), (F.col("code") % PAGE).alias("at"))
    out = bytearray(bits // 8)
    for r in coded.repartition("page").groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        out[r["page"] * (PAGE // 8) : (r["page"] + 1) * (PAGE // 8)] = r["bits"]
    return bytes(out)


def _marked(field: bytes, key: np.ndarray) -> np.ndarray:
    """Whether the field has these keys; some that aren't among its keys seem to be."""
    bits = np.frombuffer(field, np.uint8)
    code = key % (8 * len(bits))
    return (bits[code >> 3] >> (code & 7).astype(np.uint8)) & 1 == 1


def _unit_sets(docs: DataFrame, text: str, candidates: DataFrame) -> DataFrame:
    """(key, n, sketch, items) of the sets that are candidates, and of few others: only these are shuffled."""
    source = docs.select(column(text).cast("string").alias("t"))
    # a key is in many candidates, so these are fewer keys than that
    needed = candidates.select(F.explode(F.array("a", "b")).alias("key"))
    field = docs.sparkSession.sparkContext.broadcast(_field(needed, 16 * candidates.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in slices(texts_of(batch.column(0))):
                _, _, values, bounds = unit_sets(part)
                key, one = np.unique(set_keys(values, bounds), return_index=True)
                one = one[_marked(field.value, key)]
                one = one[np.diff(bounds)[one] >= _LEAST]
                n = np.diff(bounds)[one]
                ends = np.concatenate([[0], np.cumsum(n)])
                items = values[np.repeat(bounds[one], n) + np.arange(n.sum()) - np.repeat(ends[:-1], n)]
                sets = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(items.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(items, ends)), pa.array(n), sketches(items, ends), sets], names=["key", "n", "sketch", "items"])

    return settled(source.mapInArrow(run, "key long, n long, sketch binary, items binary").dropDuplicates(["key"]))


def _stretches(docs: DataFrame, doc_id: str, text: str, several: DataFrame, least: int) -> DataFrame:
    """(doc_id, row, at, start, end, w0, w1, key) of units in stretches of ``least`` words of these keys, and of few others.

    That is a code of doc_id and text, a unit's number, code points and words, and the key of its set.
    """
    content = column(text).cast("string")
    source = docs.select(column(doc_id).alias("doc_id"), F.xxhash64(column(doc_id), content).alias("row"), content.alias("t")).where("doc_id is not null")
    added = [T.StructField(n, T.IntegerType()) for n in ("at", "start", "end", "w0", "w1")]
    schema = T.StructType([source.schema[0], source.schema[1], *added, T.StructField("key", T.LongType())])
    field = docs.sparkSession.sparkContext.broadcast(_field(several.select("key"), 32 * several.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(texts_of(batch.column(2))):
                found, edges, values, bounds = unit_sets(part)
                key = set_keys(values, bounds)
                keep, size = _marked(field.value, key), np.diff(edges)
                owner = np.searchsorted(found.bounds, edges[:-1], "right") - 1
                opens = keep.copy()
                opens[1:] &= ~(keep[:-1] & (owner[1:] == owner[:-1]))
                stretch = np.cumsum(opens) - 1
                keep[keep] = np.bincount(stretch[keep], size[keep])[stretch[keep]] >= least
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                inner = np.flatnonzero((part.data & 0xC0) == 0x80)  # bytes that begin no code point
                text_of = owner[at]
                begin, end, base = edges[at], edges[at + 1], found.bounds[text_of]
                origin, start, stop = (x - np.searchsorted(inner, x) for x in (part.offsets[text_of], found.start[begin], found.end[end - 1]))
                columns = [at - np.searchsorted(owner, text_of), start - origin, stop - origin, begin - base, end - base]
                rows = batch.slice(first, last - first).select([0, 1]).take(pa.array(text_of))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c, pa.int32()) for c in columns), pa.array(key[at])], names=schema.names)

    return source.mapInArrow(run, schema)


def _long_stretches(named: DataFrame, least: int) -> DataFrame:
    """(cluster, doc_id, start, end, passage) of units whose stretch has that many words; sorted once, a stretch at a time.

    A task holds back only what it has of a stretch that is too short so far.
    """
    integers = [T.StructField(n, T.LongType()) for n in ("start", "end", "passage")]
    schema = T.StructType([named.schema["cluster"], named.schema["doc_id"], *integers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = None  # the rows of a stretch that is too short so far; or the row, unit and passage of the one before
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not len(rows):
                continue
            row, at, start, w0, w1 = (rows.column(c).to_numpy() for c in ("row", "at", "start", "w0", "w1"))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] < at[:-1]) | (at[1:] > at[:-1] + 1)
            heads = np.flatnonzero(new)
            passage = start[heads].astype(np.int64)
            long_enough = w1[np.append(heads[1:], len(row)) - 1] - w0[heads] >= least
            if last is not None and row[0] == last[0] and at[0] in (last[1], last[1] + 1):
                passage[0], long_enough[0] = last[2], True
            held, last = (None, (row[-1], at[-1], passage[-1])) if long_enough[-1] else (rows.slice(heads[-1]), None)
            of = np.cumsum(new) - 1
            kept = np.flatnonzero(long_enough[of])
            found = rows.take(pa.array(kept))
            columns = [found.column("cluster"), found.column("doc_id"), *(found.column(c).cast(pa.int64()) for c in ("start", "end")), pa.array(passage[of[kept]])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    needed = named.select("cluster", "doc_id", "row", "at", "start", "end", "w0", "w1")
    return settled(needed.repartition("row").sortWithinPartitions("row", "doc_id", "at").mapInArrow(run, schema))


def passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = PASSAGE) -> DataFrame:
    """(component_id, doc_id, start, end, kept, passage) of every unit of a passage that is repeated.

    A passage is a stretch of adjacent units of one text, of ``least`` words or more together, that each stand, or nearly stand
    (Jaccard similarity of five-word shingles of 0.8 or more, and what such links lead to), elsewhere too, within the same
    text or in another. Line ends don't matter. Positions are code points; ``passage`` is where the passage starts.
    ``component_id`` is the least doc_id of the unit's cluster within passages; ``kept`` marks its first place there. Null,
    empty and shorter texts and rows with a null doc_id have no rows; rows of one doc_id and text share their places, and each
    counts. Rows of one doc_id and other texts are told apart. An empty table gives none; other columns are ignored.
    """
    usable = docs.where(column(doc_id).isNotNull())
    found = _unit_candidates(usable, text)
    candidates = found.where("sig is not null")
    copies = found.where("sig is null").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("n")).where("n > 1").select("key")
    sets = _unit_sets(usable, text, candidates)
    groups = joined_up(candidates, sets.select("key", "n", "sketch"), lambda pairs: _compared(pairs, sets.select("key", "items")))
    several = copies.join(groups.withColumnRenamed("node", "key"), "key", "full")
    several = settled(several.select("key", F.coalesce("component", "key").alias("cluster")))
    named = _stretches(docs, doc_id, text, several, least).join(several, "key")
    whole = _long_stretches(named, least)
    place = F.struct("doc_id", "start")
    firsts = whole.groupBy("cluster").agg(F.min(place).alias("first"))
    return whole.join(firsts, "cluster").select(F.col("first.doc_id").alias("component_id"), "doc_id", "start", "end", (place == F.col("first")).alias("kept"), "passage")


def op8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
