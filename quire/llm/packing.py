"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing places the longest pieces first, each into the open sequence with the least room that still holds it.
Lengths are whole numbers up to the capacity, so the order of pieces is fixed by a histogram of lengths: at most
``capacity`` counts, whatever the number of documents. The plan is made on those counts: a segment tree over remaining
capacities finds the tightest open sequences in logarithmic time, for a run of equally long pieces at a time, exactly as
if they were placed one by one. Its rules say which ranks of a length go to which sequences; pieces are ranked within
their length by the task that cut them plus the counts of the tasks before, and look their place up. Texts and ids are
never shuffled, and no task sees more than its own pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.tables import column, settled, table
from quire.llm.words import slices, texts_of

CAPACITY = 2048
END = 0
SPECIAL = b"<|endoftext|>"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _full(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _quick(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})


class Encoder:
    """Ids of a byte-level BPE vocabulary, as the tokenizers library gives them.

    The rank file of the same vocabulary is several times faster and gives the same ids for texts without special tokens
    (tested); any other text, and every text if there is no rank file, goes through the tokenizers library.
    """

    def __init__(self, path: str, ranks: str | None):
        self.path, self.ranks = path, ranks

    def ids(self, text: bytes) -> np.ndarray:
        decoded = text.decode("utf-8", "replace")
        if self.ranks and SPECIAL not in text:
            return _quick(self.ranks).encode_to_numpy(decoded).astype("<u4", copy=False)
        return np.array(_full(self.path).encode(decoded, add_special_tokens=False).ids, "<u4")


def pieces(
    docs: DataFrame, text: str, keep: Sequence[str], encoder: Encoder, capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """One row per piece: ``keep``, piece, start, length, ids (little-endian unsigned 32-bit), task, rank.

    A document is its ids, then ``end``. Longer ones are cut into pieces of ``capacity`` ids, the first one taking what
    is left over. ``rank`` counts pieces of a length within the task that cut them. The result is written, since ranks
    hold for one run of the tasks.
    """
    names = ["piece", "start", "length", "ids", "task", "rank"]
    types = [T.IntegerType(), T.LongType(), T.LongType(), T.BinaryType(), T.IntegerType(), T.LongType()]
    source = docs.select(*[column(c).alias(f"k{i}") for i, c in enumerate(keep)], column(text).cast("string").alias("t"))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(n, t) for n, t in zip(names, types, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(batch.num_columns - 1))
            for first, last, part in slices(texts):
                raw = part.data.tobytes()
                whole, counts = [], []
                for i in range(last - first):
                    ids = encoder.ids(raw[part.offsets[i] : part.offsets[i + 1]])
                    whole += [ids, np.array([end], "<u4")]
                    counts.append(len(ids) + 1)
                n = np.array(counts)
                per = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), per)
                piece = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                head = n - (per - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                order = np.argsort(length, kind="stable")
                run_ = length[order]
                within = np.arange(len(run_)) - np.searchsorted(run_, run_)
                rank = np.empty(len(run_), np.int64)
                rank[order] = seen[run_] + within
                np.add.at(seen, length, 1)
                edges = np.concatenate([[0], np.cumsum(length)]) * 4
                data = np.concatenate(whole).tobytes()
                ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
                kept = [c.slice(first, last - first).take(pa.array(doc)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), ids, pa.array(np.full(len(length), task, np.int32)), pa.array(rank)],
                    names=[*batch.schema.names[:-1], *names],
                )

    return settled(source.mapInArrow(run, schema))


class RoomTree:
    """A segment tree over remaining capacities: is any sequence with that much room open?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def put(self, room: int, is_open: bool) -> None:
        at = room + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            both = self.open[2 * at] or self.open[2 * at + 1]
            if self.open[at] == both:
                break
            self.open[at] = both

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that an open sequence has."""
        at = length + self.size
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rules (length, first rank, first sequence, pieces in each, offset), ascending by length and first rank."""
    tree, groups, rules, bins = RoomTree(capacity), {}, [], 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            groups.setdefault(room, []).append((first, n))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = groups[room].pop()
                if not groups[room]:
                    tree.put(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                rules.append((length, rank, first, each, capacity - room))
                add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                rules.append((length, rank, first + full, left, capacity - room))
                add(room - left * length, first + full, 1)
                full, left = full + 1, 0
            if full < n:
                add(room, first + full, n - full)
    return np.array(sorted(rules), np.int64).reshape(-1, 5)


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` without ids, with ``sequence_id`` and ``offset``; (task, length, rank) still tells every piece apart."""
    light = cut.drop("ids").withColumn("place", F.col("rank"))
    sizes = settled(light.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # one row for each length, so at most ``capacity`` rows
    totals = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rules = cut.sparkSession.sparkContext.broadcast(best_fit(totals, capacity))
    joined = light.join(starts, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    out = joined.drop("before")
    schema = T.StructType([*out.drop("rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = rules.value
        shift = np.int64(1) << 50
        keys = table_[:, 0] * shift + table_[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            rule = table_[np.searchsorted(keys, length * shift + rank, "right") - 1] if len(length) else table_[:0]
            nth = rank - rule[:, 1]
            sequence, offset = rule[:, 2] + nth // np.maximum(rule[:, 3], 1), rule[:, 4] + nth % np.maximum(rule[:, 3], 1) * length
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return out.mapInArrow(run, schema).withColumnRenamed("place", "rank")


def pack(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    end: int = END,
    encoder: Encoder | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(the pieces with their ids, the pieces with their places).

    Pieces with ids: doc_id, piece, start, length, ids, task, rank. Places: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset; sequences have no gaps. Null and empty texts are one piece, the end id alone; null doc_ids are
    kept; repeated documents are packed each; a table without rows gives none; other columns are left out.
    """
    encoder = encoder or Encoder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
    cut = pieces(docs, text, [doc_id], encoder, capacity, end).withColumnRenamed("k0", "doc_id")
    digest = cut.withColumn("ids_crc32", F.crc32("ids"))
    return cut, placed(digest, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The training sequences of ``pack``'s pieces: sequence_id, ids (bytes), doc_ids in order; repeated and null ids included.

    A sequence holds at most ``capacity`` pieces.
    """
    key = ["task", "length", "rank"]
    rows = cut.select(*key, "doc_id", "ids").join(placed(cut, capacity).select(*key, "sequence_id", "offset"), key)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    packed = rows.groupBy("sequence_id").agg(ordered.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))[1]
