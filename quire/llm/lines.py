"""Line dedup: lines that many documents share are found by probing a sharded minimal perfect hash, not by joining lines.

A line's key is a 128-bit code of the stripped, lower-cased line. Tasks count the documents of each key before anything is
shuffled, so a line that every document holds costs one row a task. The keys found in enough documents are dealt into shards
by their codes; each shard gets a minimal perfect hash and two arrays in its order: 64-bit fingerprints, which tell a
foreign line from the one whose place it hits, and counts of documents. Documents then go through one narrow stage: every
line looks up its shard, its place there, compares fingerprints and reads its count. No text is shuffled.

The index reaches the tasks in portions of ``PORTION`` shards, each of a size bounded by ``SHARD`` keys a shard; the driver
and a task hold one portion at a time. A task probes a stretch of documents against one portion after the other, so a
larger index means more portions and not more memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.tables import column, extended, fresh, settled, table
from quire.llm.words import mix, slices, texts_of

DOCUMENTS = 10  # lines found in so many documents go
LENGTH = 1  # shorter keys, in code points, stay
SHARD = 1 << 15  # keys of a shard, about
PORTION = 64  # shards that are looked up together: about 2 million keys, 25 MB
HELD = 1 << 19  # keys that a task counts before it gives them away
STRETCH = 1 << 26  # bytes of text that are looked up together

_BLANK = b" \t\n\x0b\x0c\r"
_WIDE = np.dtype([("a", "<u8"), ("b", "<u8")])


def split(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def key_of(line: bytes, length: int) -> bytes:
    """The 16-byte code of a line's key; empty for keys of fewer than ``length`` code points."""
    key = line.strip(_BLANK).lower()
    if not key or (length > 1 and len(key.decode("utf-8", "replace")) < length):
        return b""
    return blake2b(key, digest_size=16).digest()


# --- minimal perfect hash ------------------------------------------------------


@dataclass
class PerfectHash:
    """Distinct keys (a, b) to the numbers from 0 to n - 1.

    Keys fall on the bits of a first level; those that are alone on theirs set it, the others go on to the next, smaller
    level, until none is left. A key's number is the count of bits set before its own: about four bits a key in all.
    """

    sizes: np.ndarray  # bits of each level
    bits: np.ndarray  # of all levels, as bytes of eight

    @staticmethod
    def _at(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((mix(a, level) ^ mix(b, level + 1000)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(a):
            size = (len(a) * 5 // 4 + 8) // 8 * 8
            at = cls._at(a, b, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone))
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(np.array(sizes, "<i4"), np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key; a foreign key gets any number, or -1."""
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])
        out, left, first = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self._at(a[left], b[left], level, size)
            byte, bit = first + (at >> 3), at & 7
            value = self.bits[byte].astype(np.int64)
            hit = (value >> (7 - bit)) & 1 == 1
            inside = np.bitwise_count((value[hit] >> (8 - bit[hit])).astype(np.uint8))
            out[left[hit]] = before[byte[hit]] + inside
            left, first = left[~hit], first + size // 8
        return out


_INDEX = "shard long, sizes binary, bits binary, fingerprints binary, counts binary"


def _shard(key: tuple, group: pa.Table) -> pa.Table:
    a, b = (group.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    hashed = PerfectHash.build(a, b)
    at = hashed.slots(a, b)
    fingerprints, counts = np.empty(len(a), "<u8"), np.empty(len(a), "<u4")
    fingerprints[at] = a
    counts[at] = np.minimum(group.column("n").to_numpy(), np.iinfo(np.uint32).max)
    fields = [hashed.sizes, hashed.bits, fingerprints, counts]
    return pa.table([pa.array([key[0].as_py()], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in fields]], names=["shard", "sizes", "bits", "fingerprints", "counts"])


def _shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return (mix(a, 77) % np.uint64(shards)).astype(np.int64)


# --- counting and indexing ------------------------------------------------------


def _counted(docs: DataFrame, text: str, length: int) -> DataFrame:
    """(a, b, n): in how many rows a task found each key, or a portion of the task."""

    def portion(held: dict[bytes, int]) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(held), _WIDE)
        a, b = (np.ascontiguousarray(keys[c]).view(np.int64) for c in ("a", "b"))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(list(held.values()), pa.int64())], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for value in batch.column("t"):
                if not value.is_valid:
                    continue
                found = {key_of(line, length) for line in split(value.as_buffer().to_pybytes())}
                found.discard(b"")
                for key in found:
                    held[key] = held.get(key, 0) + 1
                if len(held) >= HELD:
                    yield portion(held)
                    held = {}
        if held:
            yield portion(held)

    return docs.select(column(text).cast("string").alias("t")).mapInArrow(run, "a long, b long, n long")


@dataclass
class LineIndex:
    """Keys of common lines in portions of shards; ``portions`` are read by tasks one after the other."""

    portions: list[Broadcast]
    shards: int
    least: int
    length: int

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """In how many documents each key was found; 0 for keys that aren't in the index."""
        a, b = np.ascontiguousarray(keys["a"]), np.ascontiguousarray(keys["b"])
        out = np.zeros(len(a), np.int64)
        if not self.portions or not len(a):
            return out
        shard = _shard_of(a, self.shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for portion in self.portions:
            for number, (sizes, bits, fingerprints, counts) in portion.value.items():
                at = order[edges[number] : edges[number + 1]]
                if not len(at):
                    continue
                hashed = PerfectHash(np.frombuffer(sizes, "<i4"), np.frombuffer(bits, np.uint8))
                slot = hashed.slots(a[at], b[at])
                same = (slot >= 0) & (np.frombuffer(fingerprints, "<u8")[slot] == a[at])
                out[at[same]] = np.frombuffer(counts, "<u4")[slot[same]]
            if len(self.portions) > 1:  # a task holds one portion at a time
                portion.__dict__.pop("_value", None)
        return out


def line_index(docs: DataFrame, text: str = "text", least: int = DOCUMENTS, length: int = LENGTH) -> LineIndex:
    """The lines found in at least ``least`` rows, whose keys have at least ``length`` code points."""
    found = _counted(docs, text, length).groupBy("a", "b").agg(F.sum("n").alias("n"))
    common = settled(found.where(F.col("n") >= least))
    shards = max(1, -(-common.count() // SHARD))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(a, shards)), *batch.columns], names=["shard", *batch.schema.names])

    rows = settled(common.mapInArrow(dealt, "shard long, a long, b long, n long").groupBy("shard").applyInArrow(_shard, _INDEX))
    context, portions = docs.sparkSession.sparkContext, []
    for first in range(0, shards, PORTION):  # one portion at a time, of bounded size
        part = rows.where(F.col("shard").between(first, first + PORTION - 1)).collect()
        if part:
            portions.append(context.broadcast({r["shard"]: tuple(bytes(r[c]) for c in ("sizes", "bits", "fingerprints", "counts")) for r in part}))
    return LineIndex(portions, shards, least, length)


# --- dropping ---------------------------------------------------------------------


def without_common_lines(
    docs: DataFrame, text: str = "text", least: int = DOCUMENTS, length: int = LENGTH, index: LineIndex | None = None
) -> DataFrame:
    """``docs`` with common lines taken out of ``text``, and n_lines, n_dropped (long).

    Texts are split at ``\\n``. A line's key is the line without ASCII white space at both ends, with A-Z lower-cased. Keys
    of at least ``length`` code points found in at least ``least`` rows lose all their lines in every row; the other lines
    stay as they are, joined by ``\\n``. An ``index`` of other documents may be given instead of counting these.

    A null text stays null and counts as one empty line; an empty text is one empty line; empty keys never go. Repeated rows
    count as rows each. Other columns are kept; columns named n_lines or n_dropped are replaced. No rows give none.
    """
    known = index or line_index(docs, text, least, length)

    def run(values: pa.Array) -> Iterable[tuple[int, int, list[pa.Array]]]:
        for first, last, part in slices(texts_of(values), STRETCH):
            data, lines, at, keys = part.data.tobytes(), [], [], []
            edges = [0]
            for i in range(last - first):
                for line in split(data[part.offsets[i] : part.offsets[i + 1]]):
                    code = key_of(line, known.length)
                    if code:
                        at.append(len(lines))
                        keys.append(code)
                    lines.append(line)
                edges.append(len(lines))
            keep = np.ones(len(lines), bool)
            codes, which = np.unique(np.frombuffer(b"".join(keys), _WIDE), return_inverse=True)
            keep[np.array(at, np.int64)] = (known.counts(codes) < max(known.least, 1))[which]
            flags = keep.tolist()
            kept = [b"\n".join([x for x, k in zip(lines[i:j], flags[i:j], strict=True) if k]) for i, j in zip(edges, edges[1:], strict=False)]
            counts = np.diff(edges)
            dropped = np.add.reduceat(~keep, edges[:-1], dtype=np.int64)
            null = values.slice(first, last - first).is_null().to_numpy(zero_copy_only=False)
            yield first, last, [pa.array(kept, pa.binary(), mask=null).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped)]

    kept_text = fresh(docs, "kept")
    out = extended(docs, text, [(kept_text, T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())], run)
    old = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[column(kept_text).alias(c) if c == text else column(c) for c in old], "n_lines", "n_dropped")


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = without_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = {
    "op13_lines": r"""
with docs as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
parts as (select r, doc_id, string_split(t, chr(10)) p from docs),
lines as (select r, doc_id, unnest(range(1, len(p) + 1)) i, unnest(p) line from parts),
keyed as (select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
common as (select k from keyed where k <> '' group by k having count(distinct r) >= 10),
marked as (select keyed.*, common.k is not null gone from keyed left join common using (k))
select doc_id, count(*) n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
from marked group by r, doc_id
"""
}
