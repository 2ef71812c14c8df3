"""Repeated passages by sparse suffix arrays.

Suffixes are kept at minimisers only: of every ``SPAN`` consecutive runs of ``GRAM`` words, the one with the least code. Two
copies of a passage of ``LENGTH`` words choose the same place within its first words, and share at least ``RIGHT`` words from
there. Suffixes whose first ``RIGHT`` words stand nowhere else are dropped by counting codes. The rest are sorted by what
follows (split by ranges, so that no group has to fit into a task), compared with their neighbours, and the matches
extended to the left and right. Equal surroundings are one entry with a number of occurrences; equal documents are one
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.tables import column, settled, table
from quire.llm.words import SPACED, Texts, Words, mix, slices, texts_of, window_codes, words

LENGTH = 50
GRAM = 8
SPAN = 20
RIGHT = LENGTH - SPAN + 1
LEFT, AHEAD = SPAN, LENGTH + 2  # words of context that an entry holds
NEAR = 2  # neighbours on each side that are compared word by word


def text_keys(found: Words) -> np.ndarray:
    """A 64-bit key of each text's words in order."""
    place = np.arange(len(found.code)) - np.repeat(found.bounds[:-1], found.counts)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found.code + mix(place.astype(np.uint64), 14), 15))])
    return (mix(total[found.bounds[1:]] - total[found.bounds[:-1]] + found.counts.astype(np.uint64), 16) >> np.uint64(1)).astype(np.int64)


def minimisers(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Chosen word places with ``RIGHT`` words of the same text from there on, and the codes of these."""
    n = len(found.code)
    if n < GRAM + SPAN - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = window_codes(found.code, np.arange(n - GRAM + 1), np.full(n - GRAM + 1, GRAM), GRAM)
    least = np.argmin(np.lib.stride_tricks.sliding_window_view(gram, SPAN), axis=1) + np.arange(len(gram) - SPAN + 1)
    text = found.text_of()
    start = np.arange(len(least))
    least = np.unique(least[text[start] == text[start + SPAN + GRAM - 2]])
    least = least[least + RIGHT <= found.bounds[text[least] + 1]]
    return least, window_codes(found.code, least, np.full(len(least), RIGHT), RIGHT).view(np.int64)


def _entries(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n) of the documents; (key, g, twice): the suffixes of each, and whether one stands in it twice."""
    source = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("t")).where("doc_id is not null")
    id_type = source.schema[0].dataType.simpleString()

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(texts_of(batch.column(1))):
                found = words(part, SPACED)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(text_keys(found)), pa.array(found.counts)], names=["doc_id", "key", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in slices(texts_of(batch.column(0))):
                found = words(part, SPACED)
                place, g = minimisers(found)
                key = text_keys(found)
                owner = found.text_of()[place] if len(place) else place
                _, one = np.unique(key, return_index=True)  # a copy in the same slice adds nothing
                keep = np.isin(owner, one)
                pairs, count = np.unique(np.stack([owner[keep], g[keep]]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key[pairs[0]]), pa.array(pairs[1]), pa.array(count > 1)], names=["key", "g", "twice"])

    known = settled(source.mapInArrow(identify, f"doc_id {id_type}, key long, n long"))
    return known, settled(source.select("t").mapInArrow(choose, "key long, g long, twice boolean"))


def _contexts(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(key, pos, c, g, left, right, context) of the wanted suffixes (doc_id, key, gs)."""
    source = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("t")).join(wanted, "doc_id").select("t", "key", "gs")
    schema = "key long, pos long, c long, g long, left int, right int, context binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(texts_of(batch.column(0))):
                found = words(part, SPACED)
                same = text_keys(found) == batch.column(1).slice(first, last - first).to_numpy()
                place, g = minimisers(found)
                owner = found.text_of()[place] if len(place) else place
                gs = batch.column(2).slice(first, last - first)
                listed = np.repeat(np.arange(last - first), gs.value_lengths().fill_null(0).to_numpy())
                ok = np.zeros(len(place), bool)
                edges = np.searchsorted(owner, np.arange(last - first + 1))
                flat, bounds = gs.flatten().to_numpy(), np.searchsorted(listed, np.arange(last - first + 1))
                for i in np.flatnonzero(same):
                    ok[edges[i] : edges[i + 1]] = np.isin(g[edges[i] : edges[i + 1]], flat[bounds[i] : bounds[i + 1]])
                place, g, owner = place[ok], g[ok], owner[ok]
                if not len(place):
                    continue
                low, high = found.bounds[owner], found.bounds[owner + 1]
                left, right = np.minimum(LEFT, place - low), np.minimum(AHEAD, high - place)
                small = (found.code >> np.uint64(32)).astype("<u4") | np.uint32(1)
                at = place[:, None] + np.arange(-LEFT, AHEAD)
                inside = (at >= low[:, None]) & (at < high[:, None])
                context = np.where(inside, small[np.clip(at, 0, len(small) - 1)], np.uint32(0))
                c = np.zeros(len(place), np.uint64)
                for k in range(context.shape[1]):
                    c = mix(c + np.where(inside[:, k], found.code[np.clip(at[:, k], 0, len(small) - 1)], np.uint64(0)), k)
                _, one = np.unique(c, return_index=True)
                first_ = np.zeros(len(c), bool)
                first_[one] = True
                raw = pa.array([x.tobytes() if f else None for x, f in zip(context, first_, strict=True)], pa.binary())
                key = batch.column(1).slice(first, last - first).take(pa.array(owner))
                rows = [key, pa.array(place - low), pa.array(c.view(np.int64)), pa.array(g), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), raw]
                yield pa.RecordBatch.from_arrays(rows, names=["key", "pos", "c", "g", "left", "right", "context"])

    return settled(source.mapInArrow(run, schema))


def _compare(g: np.ndarray, context: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that sorted entries share to the left and right with the entry ``step`` further; none with another ``g``."""
    a, b = context[:-step], context[step:]
    equal = (a == b) & (a != 0) & (g[:-step] == g[step:])[:, None]
    right = np.cumprod(equal[:, LEFT:], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    left = np.cumprod(equal[:, :LEFT][:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return left, right


_POWERS = np.multiply.accumulate(np.full(LEFT + AHEAD, 0x9E3779B97F4A7C13, np.uint64))


def _windows(g: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, words before the minimiser, code) of the windows to look up of the entries ``at``.

    ``left`` and ``right`` are what each entry shares with the next; entries in ``edge`` have a neighbour elsewhere.
    """
    l = np.arange(SPAN)
    # what an entry shares with the one before, then with either
    before_left, before_right = (np.concatenate([[0], x])[: len(g)] for x in (left, right))
    reach = np.maximum(before_right, np.concatenate([right, [0]]))
    reach[edge] = AHEAD
    has = context != 0
    there_right = np.cumprod(has[at, LEFT:], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    there_left = np.cumprod(has[at, :LEFT][:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    wanted = (l <= there_left[:, None]) & (LENGTH - l <= np.minimum(there_right, reach[at])[:, None])
    wanted &= ~((l <= before_left[at][:, None]) & (LENGTH - l <= before_right[at][:, None]))
    row, words_before = np.nonzero(wanted)
    some, row_of = np.unique(row, return_inverse=True)
    total = np.zeros((len(some), LEFT + AHEAD + 1), np.uint64)
    np.cumsum(mix(context[at[some]], 21) * _POWERS, axis=1, out=total[:, 1:])
    first = LEFT - words_before
    inside = total[row_of, first + LENGTH] - total[row_of, first]  # equal places have equal powers
    code = mix(inside + mix(g[at[row]].view(np.uint64) + words_before.astype(np.uint64), 22), 23)
    return at[row], words_before, code.view(np.int64)


_FOUND = "c long, left long, right long, g long, context binary, code long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of sorted entries; with ``code``, windows to look up; with null ``left``, entries at both ends of the partition."""
    names = ["c", "left", "right", "g", "context", "code"]
    carried, edges, done, first = None, [], 0, True

    def made(c: pa.Array, left: pa.Array, right: pa.Array, g: pa.Array | None = None, context: pa.Array | None = None, code: pa.Array | None = None) -> pa.RecordBatch:
        n = len(c)
        rest = [x if x is not None else pa.nulls(n, t) for x, t in ((g, pa.int64()), (context, pa.binary()), (code, pa.int64()))]
        return pa.RecordBatch.from_arrays([c, left, right, *rest], names=names)

    def looked_up(rows: pa.Table, until: int, last: bool) -> Iterator[pa.RecordBatch]:
        """The windows of the rows from ``done`` to ``until``."""
        c, g = rows.column("c").to_numpy(), rows.column("g").to_numpy()
        context = np.frombuffer(b"".join(rows.column("context").to_pylist()), "<u4").reshape(len(rows), LEFT + AHEAD)
        left, right = _compare(g, context, 1) if len(rows) > 1 else (np.zeros(0, np.int64),) * 2
        edge = np.array(([0] if first and done == 0 else []) + ([len(rows) - 1] if last else []), np.int64)
        row, before, code = _windows(g, context, left, right, np.arange(done, until), edge)
        yield made(pa.array(c[row]), pa.array(before), pa.array(LENGTH - before), code=pa.array(code))

    for batch in batches:
        rows = pa.Table.from_batches([batch]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([batch])])
        c, g = rows.column("c").to_numpy(), rows.column("g").to_numpy()
        context = np.frombuffer(b"".join(rows.column("context").to_pylist()), "<u4").reshape(len(rows), LEFT + AHEAD)
        for step in range(1, min(NEAR + 1, len(rows))):
            left, right = _compare(g, context, step)
            hit = left + right >= LENGTH
            for ends in (c[:-step][hit], c[step:][hit]):
                yield made(pa.array(ends), pa.array(left[hit]), pa.array(right[hit]))
        if not edges:
            edges.append(rows.slice(0, NEAR))
        if len(rows) - 1 > done:  # the next entry of the last row is not known yet
            yield from looked_up(rows, len(rows) - 1, False)
            keep = max(0, len(rows) - max(NEAR, 2))
            first = first and keep == 0
            done, carried = len(rows) - 1 - keep, rows.slice(keep)
        else:
            carried = rows
    if carried is not None and len(carried):
        yield from looked_up(carried, len(carried), True)
        both = pa.concat_tables([*edges, carried.slice(max(0, len(carried) - NEAR))])
        none = pa.nulls(len(both), pa.int64())
        yield made(both.column("c").combine_chunks(), none, none, both.column("g").combine_chunks(), both.column("context").combine_chunks())


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start_word, end_word, n_docs): merged passages of ``LENGTH`` words or more that stand elsewhere too.

    Words are lower-cased (A-Z) and end at ASCII white space; ends are exclusive. A passage may be repeated within one
    document. ``n_docs`` is the number of documents of equal words, the document included. Null, empty and shorter texts
    have no rows, nor have rows with a null doc_id; repeated rows count as other documents. An empty table gives none;
    other columns are ignored.
    """
    known, entries = _entries(docs, doc_id, text)
    shared = entries.groupBy("g").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("twice").alias("twice")).where("lo <> hi or twice").select("g")
    gs = entries.join(shared, "g", "left_semi").groupBy("key").agg(F.collect_set("g").alias("gs"))
    copies = settled(known.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"), F.first("n").alias("n")))
    wanted = settled(copies.join(gs, "key").select("doc_id", "key", "gs"))
    found = _contexts(docs, doc_id, text, wanted)
    places = F.struct("key", "pos")
    # of an entry that stands in several places, all its words are repeated
    entry = settled(
        found.groupBy("c").agg(F.first("g").alias("g"), F.first("left").alias("left"), F.first("right").alias("right"), F.first("context", ignorenulls=True).alias("context"), (F.min(places) != F.max(places)).alias("several"))
    )
    several = entry.where(F.col("several") & (F.col("left") + F.col("right") >= LENGTH)).select("c", F.col("left").cast("long"), F.col("right").cast("long"))
    ahead = F.substring("context", 4 * LEFT + 1, 4 * AHEAD)
    ordered = entry.select("c", "g", "context", ahead.alias("ahead")).repartitionByRange("g", "ahead").sortWithinPartitions("g", "ahead", "context").drop("ahead")
    near = settled(ordered.mapInArrow(_neighbours, _FOUND))
    # a few entries of each partition
    edges = near.where("left is null").select("c", "g", "context", F.substring("context", 4 * LEFT + 1, 4 * AHEAD).alias("ahead")).distinct()
    edges = edges.coalesce(1).sortWithinPartitions("g", "ahead", "context").drop("ahead").mapInArrow(_neighbours, _FOUND)
    beside = near.unionByName(edges.where("code is null")).where("left is not null and code is null").select("c", "left", "right")
    windows = near.where("code is not null").select("code", "c", "left", "right")
    often = windows.groupBy("code").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("code")
    far = windows.join(often, "code", "left_semi").select("c", "left", "right")
    hits = settled(several.union(beside).union(far).distinct())
    spans = found.select("key", "pos", "c").join(hits, "c").select("key", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + F.col("right")).alias("e")).distinct()
    order = Window.partitionBy("key").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("s") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
    spans = spans.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = spans.groupBy("key", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    copied = copies.where(F.col("n_docs") > 1)
    of_copies = copied.where(F.col("n") >= LENGTH).select("key", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), "n_docs")
    of_others = merged.join(copies.where(F.col("n_docs") == 1).select("key", "n_docs"), "key").select("key", F.col("s").alias("start_word"), F.col("e").alias("end_word"), "n_docs")
    spans = settled(of_copies).union(settled(of_others))
    return known.select("doc_id", "key").join(spans, "key").select("doc_id", "start_word", "end_word", "n_docs")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))


SQL = {
    "op5_suffixes": r"""
with w as (
  select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws
  from documents where doc_id is not null),
windows as (select r, i s, array_to_string(ws[i + 1:i + 50], ' ') g from (select r, ws, unnest(range(0, len(ws) - 49)) i from w where len(ws) >= 50)),
often as (select g from windows group by g having count(*) > 1),
hits as (select r, s from windows semi join often using (g)),
marked as (select r, s, case when s > lag(s) over (partition by r order by s) + 50 then 1 else 0 end n from hits),
parts as (select r, s, sum(n) over (partition by r order by s) p from marked),
spans as (select r, p, min(s) start_word, max(s) + 50 end_word from parts group by r, p),
copies as (select ws, count(*) n_docs from w group by ws)
select doc_id, start_word, end_word, n_docs from spans join w using (r) join copies using (ws)
"""
}
