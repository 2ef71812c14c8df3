"""Benchmark decontamination: an FM-index for each training shard, searched backward for every test phrase.

A shard is a run of texts of about ``SHARD_BYTES``, or one that is longer. Its words become symbols of the test phrases' vocabulary; a word outside
the vocabulary is a separator, and stretches between separators that are shorter than the shortest phrase are left out,
since no phrase fits into them. Over the rest stand a suffix array (prefix doubling), the Burrows-Wheeler transform, a
wavelet matrix for ranks, and sampled suffix positions. All phrases are searched at once, word by word from their end;
occurrences are located by walking to the next sampled position, and merged into removal spans.

Documents are never shuffled. Test items come to the tasks in blocks of at most ``BLOCK_CHARS`` characters (or one item
that is longer), one pass over the documents for each block, so the memory of a task doesn't grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.tables import column, extended, fresh, settled, table
from quire.llm.words import ALNUM, runs, slices, texts_of, window_codes, words

WINDOW = 13
BLOCK_CHARS = 4_000_000
SHARD_BYTES = 1_000_000
_SAMPLE = 8  # every so many text positions, the index keeps the suffix's place


class WaveletMatrix:
    """Ranks in a sequence of symbols: one bit vector for each binary digit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            full = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            full[: len(packed)] = packed
            blocks = full.view(np.uint64)
            self.bits.append(blocks)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)]))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.origin = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, blocks, ones, zeros in zip(reversed(range(self.levels)), self.bits, self.ones, self.zeros, strict=True):
            word, rest = place >> 6, (place & 63).astype(np.uint64)
            below = blocks[word] & ((np.uint64(1) << rest) - np.uint64(1))
            one = ones[word] + np.bitwise_count(below)
            place = np.where((symbol >> level) & 1 == 1, zeros + one, place - one)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, place) - self.origin[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_ = symbols[order]
    rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    width = 1
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        width *= 2
    return order


class FmIndex:
    """Full-text index of a sequence of symbols from 1; 0 is kept for its end."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        text = np.append(symbols, 0).astype(np.int64)
        places = suffix_array(text)
        self.bwt = text[places - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.matrix = WaveletMatrix(self.bwt, sigma)
        kept = places % _SAMPLE == 0
        self.kept, self.sampled = kept, places[kept]
        self.nth = np.cumsum(kept) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the sorted suffixes that begin with each phrase: from, to."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                continue
            symbol = phrases[live, lengths[live] - 1 - step]
            low[live] = self.first[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        found, steps, rows = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        live = np.arange(len(rows))
        while len(live):
            there = self.kept[rows[live]]
            done = live[there]
            found[done] = self.sampled[self.nth[rows[done]]] + steps[done]
            live = live[~there]
            symbol = self.bwt[rows[live]]
            rows[live] = self.first[symbol] + self.matrix.rank(symbol, rows[live])
            steps[live] += 1
        return found


class Phrases:
    """The distinct windows of a block of test items, as symbols of their vocabulary."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        found = words(texts_of(pa.array(texts, pa.large_string())), ALNUM)
        first, length, edges = runs(found.bounds, window)
        codes = window_codes(found.code, first, length, window)
        item = np.repeat(np.arange(len(ids)), np.diff(edges))
        _, at, which = np.unique(codes, return_index=True, return_inverse=True)
        self.window, self.ids, self.vocabulary = window, np.array(ids, object), np.unique(found.code)
        self.words = (np.searchsorted(self.vocabulary, found.code) + 2).astype(np.int32)
        self.first, self.length = first[at], length[at]
        order = np.argsort(which, kind="stable")
        self.items, self.item_bounds = item[order], np.searchsorted(which[order], np.arange(len(at) + 1))
        self.shortest = int(self.length.min()) if len(at) else 0

    def matrix(self) -> np.ndarray:
        at = np.minimum(self.first[:, None] + np.arange(self.window), len(self.words) - 1)
        return np.where(np.arange(self.window) < self.length[:, None], self.words[at], 0).astype(np.int64)


def _symbols(codes: np.ndarray, text: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the stretches that can hold a phrase, a separator (1) after each, and the word each stands for."""
    if not len(phrases.vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(phrases.vocabulary, codes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == codes
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (text[1:] != text[:-1])
    start = np.flatnonzero(begins)
    stretch = np.cumsum(begins) - 1
    size = np.bincount(stretch[known], minlength=len(start)) if len(start) else start
    keep = known.copy()
    keep[known] = size[stretch[known]] >= phrases.shortest
    place = np.flatnonzero(keep)
    if not len(place):
        return np.zeros(0, np.int64), place
    ends = np.flatnonzero(np.append(stretch[place][1:] != stretch[place][:-1], True)) + 1
    return np.insert(at[place] + 2, ends, 1), np.insert(place, ends, -1)


def _search(codes: np.ndarray, text: np.ndarray, n_texts: int, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of a shard: which are hit; and pairs (text, item), distinct."""
    hit, none = np.zeros(len(codes), bool), np.zeros(0, np.int64)
    symbols, place = _symbols(codes, text, phrases)
    if not len(symbols):
        return hit, none, none
    index = FmIndex(symbols, len(phrases.vocabulary) + 2)
    low, high = index.search(phrases.matrix(), phrases.length)
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    start = place[index.locate(rows)]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + phrases.length[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    pairs = np.unique(text[start] * np.int64(len(low)) + which) if len(which) else none
    doc, which = pairs // max(len(low), 1), pairs % max(len(low), 1)
    sizes = phrases.item_bounds[which + 1] - phrases.item_bounds[which]
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(phrases.item_bounds[which], sizes)
    pairs = np.unique(np.repeat(doc, sizes) * np.int64(len(phrases.ids)) + phrases.items[at])
    return hit, pairs // len(phrases.ids), pairs % len(phrases.ids)


def _list_array(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _scan(column_: pa.Array, phrases: Phrases) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each text: number of words, byte-exact removal spans in code points with their words, item ids."""
    texts = texts_of(column_)
    n_words = np.zeros(len(texts), np.int64)
    spans, items = [], []
    for first, last, part in slices(texts, SHARD_BYTES):
        found = words(part, ALNUM)
        n_words[first:last] = found.counts
        text = found.text_of()
        hit, doc, item = _search(found.code, text, last - first, phrases)
        items.append((doc + first, item))
        if hit.any():
            begins = hit.copy()
            begins[1:] &= ~hit[:-1] | (text[1:] != text[:-1])
            ends = hit.copy()
            ends[:-1] &= ~hit[1:] | (text[1:] != text[:-1])
            a, b = np.flatnonzero(begins), np.flatnonzero(ends)
            points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
            origin = points[part.offsets[text[a]]]
            spans.append((text[a] + first, points[found.start[a]] - origin, points[found.end[b]] - origin, b - a + 1))
    columns = [np.concatenate([s[k] for s in spans]) if spans else np.zeros(0, np.int64) for k in range(4)]
    kind = [("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]
    values = pa.StructArray.from_arrays([pa.array(c) for c in columns[1:]], fields=[pa.field(*f) for f in kind])
    docs = np.concatenate([i[0] for i in items]) if items else np.zeros(0, np.int64)
    which = np.concatenate([i[1] for i in items]) if items else np.zeros(0, np.int64)
    ids = pa.array(phrases.ids[which].tolist(), pa.string())
    places = np.arange(len(texts) + 1)
    return n_words, _list_array(values, np.searchsorted(columns[0], places)), _list_array(ids, np.searchsorted(docs, places))


_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "words")]))


def _pass(docs: DataFrame, text: str, phrases: Phrases, names: tuple[str, str, str]) -> DataFrame:
    """One block of items against every document; appends columns (words, spans, items)."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def compute(batch: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        n, spans, items = _scan(batch, shared.value)
        yield 0, len(batch), [pa.array(n), spans, items]

    return extended(docs, text, list(zip(names, (T.LongType(), _SPANS, T.ArrayType(T.StringType())), strict=True)), compute)


def item_blocks(items: DataFrame, item_id: str, text: str, window: int) -> Iterator[Phrases]:
    """Items in blocks of at most ``BLOCK_CHARS`` characters, or one that is longer; one block is on the driver at a time."""
    ids, texts, size = [], [], 0
    # null ids are kept apart from all texts by a character that no number has
    rows = items.select(F.coalesce(column(item_id).cast("string"), F.lit("")).alias("i"), column(text).alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        if texts and size + len(row.t) > BLOCK_CHARS:
            yield Phrases(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
    yield Phrases(ids, texts, window)


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``removal`` (merged spans: start, end in code points; words) and ``items``.

    A window is ``window`` consecutive words of an item, or a whole item of fewer words. A document word inside any
    occurrence of a window is hit. ``items`` lists the ids of the items with occurring windows, sorted as text, each once.

    Null and empty texts have no words and no hits; null and wordless items have no windows; a null item id is listed as
    an empty text; items with equal ids count as one; repeated documents are judged alike, each for itself; an empty
    benchmark hits nothing. If ``docs`` has a column of one of the new names, the new one replaces it.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "removal", "items")]
    out = docs.select(*[column(c) for c in kept])
    names = [fresh(out, n) for n in ("n_words", "removal", "items")]
    done: list[tuple[str, str]] = []
    for k, phrases in enumerate(item_blocks(items, item_id, item_text, window)):
        if k:
            out = settled(out)
        block = [f"{n}_{k}" for n in names]
        out = _pass(out, text, phrases, tuple(block))
        done.append((block[1], block[2]))
    if len(done) == 1:
        spans = F.col(done[0][0])
    else:  # spans of several blocks can touch or overlap: merge their words again
        spans = F.col(done[0][0])
        for more, _ in done[1:]:
            spans = F.concat(spans, F.col(more))
        return _merged(out, spans, text, kept, names, done)
    ids = F.array_sort(F.array_distinct(F.col(done[0][1])))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return out.select(*[column(c) for c in kept], F.col(f"{names[0]}_0").alias("n_words"), hit.alias("n_hit"), spans.alias("removal"), ids.alias("items"))


def _merged(out: DataFrame, spans, text: str, kept: list[str], names: list[str], done: list[tuple[str, str]]) -> DataFrame:
    """Union of the blocks' spans; the number of words of a union is counted in the text."""
    place = out.columns.index(text)
    joined = fresh(out, "joined")
    out = out.withColumn(joined, F.array_sort(spans))
    schema = T.StructType([*out.schema.fields[:-1], T.StructField(joined, _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content, found in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if found:
                    one = texts_of(pa.array([content], pa.large_string()))
                    w = words(one, ALNUM)
                    points = np.concatenate([[0], np.cumsum((one.data & 0xC0) != 0x80)])
                    a, b = points[w.start], points[w.end]
                    cover = np.zeros(len(a) + 1, np.int64)
                    np.add.at(cover, np.searchsorted(a, [s["start"] for s in found]), 1)
                    np.add.at(cover, np.searchsorted(b, [s["end"] for s in found]) + 1, -1)
                    hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
                    edge = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
                    found = [{"start": int(a[x]), "end": int(b[y - 1]), "words": int(y - x)} for x, y in edge]
                rows.append(found)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=batch.schema.names)

    out = out.mapInArrow(run, schema)
    ids = F.array_sort(F.array_distinct(F.concat(*[F.col(i) for _, i in done])))
    hit = F.aggregate(F.col(joined), F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return out.select(*[column(c) for c in kept], F.col(f"{names[0]}_0").alias("n_words"), hit.alias("n_hit"), F.col(joined).alias("removal"), ids.alias("items"))


def contaminated():
    """The rule for one document: at least one hit word, and one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    n = fresh(docs, "row_columns")
    packed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias(n), column(text).alias("text"))
    return contamination(packed, items).where(~contaminated()).select(*[F.col(n).getField(c).alias(c) for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


SQL = {
    "op9_decontaminate": r"""
with item_words as (
  select item_id, i, w from (
    select item_id, unnest(ws) w, generate_subscripts(ws, 1) i from (
      select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark))),
item_lists as (select item_id, list(w order by i) ws, count(*) n from item_words group by item_id),
windows as (
  select distinct item_id, list_slice(ws, s, s + least(n, 13) - 1) win from (
    select item_id, ws, n, unnest(generate_series(1, greatest(1, n - 12))) s from item_lists)),
lengths as (select distinct len(win) k from windows),
doc_lists as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
starts as (select doc_id, ws, unnest(generate_series(1, len(ws))) s from doc_lists where len(ws) > 0),
first_words as (select distinct win[1] w from windows),
hits as (
  select doc_id, s, k, item_id from (
    select doc_id, s, k, list_slice(ws, s, s + k - 1) part
    from starts join first_words on ws[s] = w, lengths where s + k - 1 <= len(ws)) join windows on part = win),
hit_words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(s, s + k - 1)) p from hits) group by 1),
hit_items as (
  select doc_id, count(*) n_items, string_agg(i, ',' order by i) ids
  from (select distinct doc_id, cast(item_id as varchar) i from hits) group by 1)
select d.doc_id, cast(coalesce(len(ws), 0) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) contaminated
from doc_lists d left join hit_words using (doc_id) left join hit_items using (doc_id)
"""
}
