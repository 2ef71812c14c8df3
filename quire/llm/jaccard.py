"""Jaccard join of word-shingle sets by PartEnum signatures.

Sets fall into bands of size. Within a band the domain of shingles is cut, by a hash, into ``n1`` parts of ``SUBPARTS``
sub-parts; for every part, each subset of ``SUBPARTS - TOLERATED`` sub-parts gives a signature: the set's projection
on them. Two sets with Jaccard similarity of 0.8 or more differ in at most a ninth of the sum of their sizes, so by the
pigeonhole principle some part holds at most ``TOLERATED`` differences, and the sets agree on one of its subsets. Empty
projections are left out: that is safe for a set with more well-filled parts than parts can be spoilt. The few sets
without enough of them give their single shingles as signatures, too; if neither set of a pair has enough, they meet there.

Sets that are equal share a 64-bit key and are one from the start. Where several sets share a signature, each is compared
with the least of them only, and the signatures are pre-aggregated in every batch, so a large group costs one row per member.
A bucket in which all comparisons succeed is connected. In the others, members that the links so far leave apart are
compared with one another, in blocks; buckets with the same members count once.

Before two sets are compared, their sketches are: the parities of their shingles in hash cells, of at most a sixteenth of the
sets' own size. The number of parities that differ is a lower bound, and a close one, of the number of shingles that one
of the sets lacks, so pairs beyond the allowed number need no look at the sets, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.graph import components, forest
from quire.llm.tables import column, fresh, settled, table
from quire.llm.words import SPACED, Texts, distinct, mix, runs, slices, texts_of, window_codes, words

SHINGLE = 5
SUBPARTS = 2
TOLERATED = 1
RATIO = 1.75  # of the sizes in a band
BLOCK = 128  # members of a bucket that are compared at a time
PAIRS = 1 << 15  # pairs of sketches that a task holds at a time


def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and their bounds."""
    found = words(texts, SPACED)
    first, length, edges = runs(found.bounds, SHINGLE)
    return distinct(window_codes(found.code, first, length, SHINGLE), edges)


def set_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, below 2 ** 63."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values, 3))])
    size = np.diff(bounds).astype(np.uint64)
    return (mix(total[bounds[1:]] - total[bounds[:-1]] + size, 4) >> np.uint64(1)).astype(np.int64)


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * inter >= 80 * (a + b - inter)


def sketches(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Of each set, the parity of its shingles in a power of two of hash cells, 2 to 4 a shingle; one bit a cell."""
    size = np.diff(bounds)
    cells = np.maximum(64, 1 << np.ceil(np.log2(2 * np.maximum(size, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(cells)])
    owner = np.repeat(np.arange(len(size)), size)
    spot = base[owner] + (mix(values, 12) % cells[owner].astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(spot, minlength=base[-1]) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(np.packbits(parity, bitorder="little").tobytes())])


def folded(sketch: pa.Scalar, size: int) -> np.ndarray:
    """A sketch as if it had been made with fewer cells, in ``size`` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch.as_buffer(), np.uint8).reshape(-1, size), axis=0)


def shortest(sketch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each sketch, and each as if it had been made with 64 cells, as a number."""
    sketch = sketch.cast(pa.large_binary())  # which may have another offset
    _, offsets, data = sketch.buffers()
    if not len(sketch):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edges = np.frombuffer(offsets, np.int64)[sketch.offset : sketch.offset + len(sketch) + 1]
    cells = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]].view(np.uint64)
    return np.diff(edges), np.bitwise_xor.reduceat(cells, (edges[:-1] - edges[0]) // 8)


def possible(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m that differ in at least ``apart`` shingles can link."""
    return (10 * np.minimum(n, m) >= 8 * np.maximum(n, m)) & (9 * apart <= n + m)


def _bands() -> np.ndarray:
    """Upper ends of the bands."""
    ends = [4]
    while ends[-1] < 1 << 40:
        ends.append(int(ends[-1] * RATIO))
    return np.array(ends)


_ENDS = _bands()


def signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets, and the index of the set of each."""
    size = np.diff(bounds)
    band = np.searchsorted(_ENDS, size)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    filled = np.flatnonzero(size > 0)
    # a set also serves as the smaller one of pairs whose larger set is in the next band
    upward = filled[10 * size[filled] >= 8 * (_ENDS[band[filled]] + 1)]
    for sets, at in ((filled, band[filled]), (upward, band[upward] + 1)):
        if not len(sets):
            continue
        end, n = _ENDS[at], size[sets]
        differ = (n + np.minimum(end, 10 * n // 8)) // 9
        parts = np.maximum(1, (0.122 * end).astype(np.int64) + 1)
        base = np.concatenate([[0], np.cumsum(parts)])
        owner = np.repeat(np.arange(len(sets)), n)
        item = values[np.repeat(bounds[sets], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        spot = (mix(item, 5) % (parts[owner] * SUBPARTS).astype(np.uint64)).astype(np.int64)
        cell = base[owner] * SUBPARTS + spot
        sums, count = np.zeros(base[-1] * SUBPARTS, np.uint64), np.bincount(cell, minlength=base[-1] * SUBPARTS)
        np.add.at(sums, cell, mix(item, 6))
        sums, count = sums.reshape(-1, SUBPARTS), count.reshape(-1, SUBPARTS)
        part_owner = np.repeat(np.arange(len(sets)), parts)
        part = np.arange(base[-1]) - base[part_owner]
        for k, chosen in enumerate(combinations(range(SUBPARTS), SUBPARTS - TOLERATED)):
            keep = np.flatnonzero(count[:, chosen].sum(axis=1) > 0)
            name = at[part_owner[keep]].astype(np.uint64) * np.uint64(1 << 40) + part[keep].astype(np.uint64) * np.uint64(16) + np.uint64(k)
            out.append((mix(sums[keep][:, chosen].sum(axis=1) + mix(name, 7), 8), sets[part_owner[keep]]))
        good = np.bincount(part_owner, (count > 0).sum(axis=1) > TOLERATED, minlength=len(sets))
        short = good <= differ // (TOLERATED + 1)
        single = short[owner]
        out.append((mix(item[single] + mix(at[owner[single]].astype(np.uint64), 9), 10), sets[owner[single]]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, n, sketch) of every document; key is null without words."""
    source = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("t"))
    added = [T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())]
    schema = T.StructType([source.schema[0], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(texts_of(batch.column(1))):
                values, bounds = shingle_sets(part)
                n = np.diff(bounds)
                key = pa.array(set_keys(values, bounds), mask=n == 0)
                rows = [batch.column(0).slice(first, last - first), key, pa.array(n), sketches(values, bounds)]
                yield pa.RecordBatch.from_arrays(rows, names=schema.names)

    return settled(source.mapInArrow(run, schema))


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    """(sig, a, b): the set b is to be compared with a, the least of those with that signature in a batch or in all."""
    source = docs.select(column(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, keys = [], []
            for _, _, part in slices(texts_of(batch.column(0))):
                values, bounds = shingle_sets(part)
                sig, which = signatures(values, bounds)
                sigs.append(sig)
                keys.append(set_keys(values, bounds)[which])
            sig, key = np.concatenate(sigs).view(np.int64), np.concatenate(keys)
            order = np.lexsort((key, sig))
            sig, key = sig[order], key[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
            sig, key = sig[new], key[new]
            head = np.ones(len(sig), bool)
            head[1:] = sig[1:] != sig[:-1]
            least = key[np.flatnonzero(head)][np.cumsum(head) - 1] if len(sig) else key
            other = pa.array(key, mask=head)  # null for the least itself
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(least), other], names=["sig", "a", "b"])

    rows = source.mapInArrow(run, "sig long, a long, b long")
    # one row for each signature and batch, and one more for each further member of it in the batch
    heads = rows.repartition("sig").sortWithinPartitions("sig", "a")
    return settled(heads.mapInArrow(_starred, "sig long, a long, b long"))


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature: members of a batch stay with their least; the least of batches go to the least of all."""
    last_sig = last_least = None
    for batch in batches:
        sig, a = batch.column("sig").to_numpy(), batch.column("a").to_numpy()
        if not len(sig):
            continue
        member = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
        b = batch.column("b").fill_null(0).to_numpy()
        head = np.ones(len(sig), bool)
        head[1:] = sig[1:] != sig[:-1]
        firsts = a[np.flatnonzero(head)].copy()
        if last_sig is not None and sig[0] == last_sig:
            firsts[0] = last_least
        least = firsts[np.cumsum(head) - 1]
        last_sig, last_least = sig[-1], least[-1]
        pairs = [(sig[member], a[member], b[member])]
        apart = ~member & (a != least)
        pairs.append((sig[apart], least[apart], a[apart]))
        columns = [np.concatenate([p[k] for p in pairs]) for k in range(3)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "a", "b"])


def _fetched(docs: DataFrame, doc_id: str, text: str, keys: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, items) of the sets that comparisons need; their documents are read again."""
    ids = settled(keys.join(needed, "key", "left_semi").where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    source = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("t")).join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in slices(texts_of(batch.column(0))):
                values, bounds = shingle_sets(part)
                sets = pa.Array.from_buffers(
                    pa.binary(), len(part), [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(values.tobytes())]
                )
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(values, bounds)), sets], names=["key", "items"])

    return settled(source.mapInArrow(run, "key long, items binary").join(ids.select("key"), "key", "left_semi").dropDuplicates(["key"]))


def _sketched(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, maybe) of pairs (a, b): whether their sketches allow a link."""
    x = known.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    y = known.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    joined = pairs.join(y, "b").join(x, "a").select("a", "b", "na", "nb", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            (nx, p), (ny, q) = shortest(x), shortest(y)
            apart = np.bitwise_count(p ^ q).astype(np.int64)
            for i in np.flatnonzero(np.minimum(nx, ny) > 8).tolist():
                cells = min(len(x[i].as_buffer()), len(y[i].as_buffer()))
                apart[i] = np.bitwise_count(folded(x[i], cells) ^ folded(y[i], cells)).sum()
            maybe = possible(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), apart)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(maybe)], names=["a", "b", "maybe"])

    return joined.mapInArrow(run, "a long, b long, maybe boolean")


def _links(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, keys: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    sets = _fetched(docs, doc_id, text, keys, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    joined = pairs.join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")  # two ascending runs: one merge
                ok[i] = linked(np.count_nonzero(both[1:] == both[:-1]), len(p), len(q))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return settled(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _rest(candidates: DataFrame, bad: DataFrame, groups: DataFrame, known: DataFrame, done: DataFrame, one_each: bool) -> DataFrame:
    """Further pairs to compare: in the bad buckets, of different components so far, and possible by their sketches.

    With ``one_each``, of these pairs only the first of each member of a block.
    """
    rows = candidates.join(bad, "sig", "left_semi")
    members = rows.select("sig", F.explode(F.array("a", "b")).alias("key")).distinct()
    members = members.join(groups, members["key"] == groups["node"], "left").select("sig", "key", F.coalesce("component", "key").alias("component"))
    mixed = members.groupBy("sig").agg(
        F.count(F.lit(1)).alias("m"),
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who"),
    )
    # the two members of a bucket have been compared; and the same members need it once
    once = mixed.where("lo <> hi and m > 2").groupBy("m", "who").agg(F.min("sig").alias("sig"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = (
        members.join(once.select("sig", "m"), "sig")
        .join(known, "key")
        .withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "component", "n", "sketch")
    )

    def pairs(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The possible pairs of one bucket's block, or of two."""
        key, part, n, own = (rows.column(c).to_numpy() for c in ("key", "component", "n", "own"))
        across = own.min() != own.max() or rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        sketch = rows.column("sketch").combine_chunks()
        cells = min(len(x.as_buffer()) for x in sketch)
        parity = np.array([folded(x, cells) for x in sketch])
        a, b = [], []
        paired = np.zeros(len(key), bool)
        for r in range(len(key) - 1):
            more = np.arange(r + 1, len(key))
            more = more[(part[more] != part[r]) & ((own[more] != own[r]) | (not across))]
            more = more[~paired[more]]
            more = more[possible(n[more], n[r], np.bitwise_count(parity[more] ^ parity[r]).sum(axis=1, dtype=np.int64))]
            paired[more] = one_each
            a.append(np.minimum(key[more], key[r]))
            b.append(np.maximum(key[more], key[r]))
        return a, b

    def small_pairs(rows: pa.Table, m: np.ndarray, edges: np.ndarray, code: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The possible pairs of all groups with more than one of ``m`` whose sketches have 64 cells, some ``PAIRS`` at a time."""
        key, part, n, own, i, j = (rows.column(c).to_numpy() for c in ("key", "component", "n", "own", "i", "j"))
        a, b, paired = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(key), bool)
        if not len(key):
            return a, b
        across = (np.minimum.reduceat(own, edges[:-1]) != np.maximum.reduceat(own, edges[:-1])) | (i != j)[edges[:-1]]
        across = np.repeat(across, np.diff(edges))
        ends = np.repeat(edges[:-1] + m, np.diff(edges))
        left = np.maximum(ends - np.arange(len(key)) - 1, 0)  # members of the group after each
        done, first = np.concatenate([[0], np.cumsum(left)]), 0
        while first < len(key):
            last = max(first + 1, int(np.searchsorted(done, done[first] + PAIRS, "right")) - 1)
            x = np.repeat(np.arange(first, last), left[first:last])
            y = x + 1 + np.arange(len(x)) - (done[x] - done[first])
            ok = (part[x] != part[y]) & ((own[x] != own[y]) | ~across[x])
            x, y = x[ok], y[ok]
            ok = possible(n[y], n[x], np.bitwise_count(code[x] ^ code[y]).astype(np.int64))
            x, y = x[ok], y[ok]
            if one_each:
                x, y = x[~paired[y]], y[~paired[y]]
                y, at = np.unique(y, return_index=True)
                x, paired[y] = x[at], True
            a.append(np.minimum(key[x], key[y]))
            b.append(np.maximum(key[x], key[y]))
            first = last
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emitted(rows: pa.Table, whole: bool) -> tuple[pa.Table, pa.RecordBatch]:
            at = np.stack([rows.column(c).to_numpy() for c in ("sig", "i", "j")])
            edges = np.concatenate([[0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, [len(rows)]])
            last = len(edges) - 1 if whole else len(edges) - 2
            rest, rows, edges = rows.slice(edges[last]), rows.slice(0, edges[last]), edges[: last + 1]
            sizes, code = shortest(rows.column("sketch").combine_chunks())
            least = np.minimum.reduceat(sizes, edges[:-1]) if last else sizes
            a, b = small_pairs(rows, np.where(least == 8, np.diff(edges), 1), edges, code)
            for g in np.flatnonzero((least > 8) & (np.diff(edges) > 1)).tolist():
                x, y = pairs(rows.slice(edges[g], edges[g + 1] - edges[g]))
                a += x
                b += y
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            return rest, pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(len(h) for h in held) > 4 * BLOCK:
                rest, out = emitted(pa.Table.from_batches(held), False)
                held = rest.to_batches()
                yield out
        if held:
            yield emitted(pa.Table.from_batches(held), True)[1]

    sorted_ = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "key")
    found = sorted_.mapInArrow(run, "a long, b long").distinct()
    return settled(found.join(done, ["a", "b"], "left_anti"))


def joined_up(candidates: DataFrame, known: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of all sets that links lead to.

    ``candidates`` (sig, a, b) is written, ``known`` has (key, n, sketch), and ``links_of`` keeps the linked ones of pairs.
    """
    checked = settled(_sketched(candidates.select("a", "b").distinct(), known))
    links = links_of(checked.where("maybe").select("a", "b"))
    failed = candidates.join(links, ["a", "b"], "left_anti").select("sig").distinct()
    done = checked.select("a", "b")
    # most of what is apart belongs together: join that up by a few pairs first, then compare all that are still apart
    for one_each in (True, False):
        more = _rest(candidates, failed, components(links), known, done, one_each)
        links, done = settled(links.union(links_of(more))), settled(done.union(more))
    return components(links)


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set holds the distinct runs of five words, or the whole
    sequence of fewer. Two documents link when their sets' Jaccard similarity is at least 0.8; ``component_id`` is the
    least doc_id that links lead to. Null, empty and blank texts have empty sets and link with nothing. Rows with a null
    doc_id link with nothing and have a null component. Repeated rows give a row each, of one component. An empty table
    gives none. Other columns are ignored. Shingles and sets are told apart by 64-bit codes.
    """
    keys = _keys(docs, doc_id, text)
    usable = docs.where(column(doc_id).isNotNull())
    known = settled(keys.where("key is not null and doc_id is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    groups = joined_up(_candidates(usable, text), known, lambda pairs: _links(pairs, usable, doc_id, text, keys))
    placed = keys.join(groups, keys["key"] == groups["node"], "left")
    placed = placed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "key")).alias("c"))
    least = placed.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    named = placed.join(least, "c", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The document of the least id of each group of similar ones, with its own columns; rows with a null id stay."""
    others = similar(docs, text, doc_id).where("doc_id <> component_id").select("doc_id").distinct()
    name = fresh(docs, "other_id")
    others = settled(others.withColumnRenamed("doc_id", name))
    return docs.join(others, column(doc_id) == F.col(name), "left_anti")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


SQL = {
    "op2_jaccard": r"""
with recursive word_lists as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') ws from documents),
shingles as (
  select distinct doc_id, array_to_string(list_slice(ws, s, s + 4), ' ') sh from (
    select doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) s from word_lists where len(ws) > 0)),
sizes as (select doc_id, count(*) n from shingles group by 1),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from shingles a join shingles b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x, y from pairs join sizes p on x = p.doc_id join sizes q on y = q.doc_id where 100 * c >= 80 * (p.n + q.n - c)),
reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x, min(y) m from reach group by 1)
select w.doc_id, coalesce(n, 0) n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) component_id
from word_lists w left join sizes s on w.doc_id = s.doc_id left join least on w.doc_id = x
"""
}
