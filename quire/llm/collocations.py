"""Phrases of two and three words that stand together more often than their parts suggest, mined with stripes.

A stripe is a counter of next words, kept for a prefix of words; the empty prefix counts words, a prefix of one word counts
pairs, one of two words counts triples. Tasks fill stripes for whole batches, and give them away in blocks: sorted arrays
of (prefix, next word, count), dealt out by a code of prefix and next word, so that the stripe of a very frequent prefix
lies in many blocks and none grows with its frequency. Blocks of one deal are merged elementwise. One structure then gives

* extensions: the entries of a prefix's stripe that are frequent enough;
* totals: how often a prefix stands anywhere is its own entry in the stripe one word shorter;
* subsumption: the greatest entry of a pair's stripe, and of the stripes it ends the prefix of, is what may swallow it.

Stripes of two-word prefixes are only filled where both pairs are frequent: no triple is more frequent than a pair within
it. A field of bits of bounded size tells so, set by codes of the frequent pairs; other pairs may hit a bit by chance, and
then only add entries that the count rules out. Words are told apart by 64-bit codes, phrases by the codes of their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.tables import column, settled, table
from quire.llm.words import Texts, byte_class, mix, slices, texts_of, words

LEAST = 10  # occurrences of a candidate
SHARE = 50  # per cent of a candidate's occurrences inside a longer one that make it go
TOP = 2000  # phrases reported for a language
MILLION = 1_000_000
DEAL = 8 << 20  # bytes of text for each deal of blocks
FULL = 1 << 21  # words that a task holds before it gives their blocks away
FIELD = 1 << 28  # bits of the field of frequent pairs, at most
PAGE = 1 << 13  # bits that are set together
SPREAD = 64  # parts in which a language's phrases are ranked first

#: Words between blanks; pieces end at these marks and at line ends.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = ~byte_class(*[(b, b) for b in b" \t" + _BREAKS])
_BREAK = byte_class(*[(b, b) for b in _BREAKS])

_BLOCK = "lang string, level int, deal int, block binary"
_ENTRY = "lang string, level int, w1 long, w2 long, w3 long, n long, word binary"


def _code(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit code of a phrase's words."""
    out = mix(parts[0], 1)
    for k, part in enumerate(parts[1:], 2):
        out = mix(out + part, k)
    return out


# --- blocks of stripes ------------------------------------------------------------


def _merged(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of ``columns`` in an order of their own, their sums, and one place of each."""
    code = _code(*columns)
    order = np.argsort(code, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = code[order][1:] != code[order][:-1]
    if len(columns) > 1:  # phrases of equal codes may differ
        differ = np.zeros(len(order), bool)
        for c in columns:
            differ[1:] |= c[order][1:] != c[order][:-1]
        if (differ & ~new).any():
            order = np.lexsort(columns)
            new[:] = False
            new[:1] = True
            for c in columns:
                new[1:] |= c[order][1:] != c[order][:-1]
    first = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
    return [c[order[first]] for c in columns], sums, order[first]


def _block(columns: list[np.ndarray], counts: np.ndarray, strings: list[bytes] | None) -> bytes:
    """Codes, counts and, for single words, the words themselves; sorted by prefix."""
    order = np.lexsort(columns[::-1])
    parts = [np.array([len(order)], "<u4").tobytes(), *[c[order].astype("<u8").tobytes() for c in columns], counts[order].astype("<u8").tobytes()]
    if strings is not None:
        parts += [np.array([len(strings[i]) for i in order], "<u4").tobytes(), b"".join([strings[i] for i in order])]
    return b"".join(parts)


def _unblocked(block: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    n = int(np.frombuffer(block, "<u4", 1)[0])
    columns = [np.frombuffer(block, "<u8", n, 4 + 8 * n * k) for k in range(width)]
    counts = np.frombuffer(block, "<u8", n, 4 + 8 * n * width).astype(np.int64)
    strings: list[bytes] = []
    if width == 1:
        at = 4 + 16 * n
        lengths = np.frombuffer(block, "<u4", n, at)
        edges = (at + 4 * n + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])).tolist()
        strings = [block[i:j] for i, j in zip(edges, edges[1:], strict=False)]
    return columns, counts, strings


def _phrases(part: Texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts and ends of the words, text of each, whether ``width`` words follow from here in one piece)."""
    w = words(part, _KIND)
    piece = np.concatenate([[0], np.cumsum(_BREAK[part.data], dtype=np.int64)])[w.start] if len(w.start) else w.start
    text = w.text_of()
    whole = np.zeros(len(text), bool)
    k = width - 1
    if len(text) > k:
        whole[: len(text) - k] = (piece[: len(text) - k] == piece[k:]) & (text[: len(text) - k] == text[k:])
    return w.code, w.start, w.end, text, whole


class _Stripes:
    """What a task has counted: per language and level distinct phrases; given away as blocks when there are many words."""

    def __init__(self, deals: int) -> None:
        self.deals, self.held, self.size = deals, {}, 0

    def add(self, lang: str, columns: list[np.ndarray], word: Callable[[int], bytes] | None = None) -> None:
        """Phrases by the codes of their words; ``word`` gives the word at a place."""
        found, sums, first = _merged(columns, np.ones(len(columns[0]), np.int64))
        named = None if word is None else [word(i) for i in first.tolist()]
        self.held.setdefault((lang, len(columns)), []).append((found, sums, named))
        self.size += len(sums)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        for (lang, level), held in self.held.items():
            joined = [np.concatenate([h[0][k] for h in held]) for k in range(level)]
            strings = [s for h in held for s in h[2]] if level == 1 else None
            columns, sums, first = _merged(joined, np.concatenate([h[1] for h in held]))
            strings = [strings[i] for i in first.tolist()] if strings is not None else None
            deal = (_code(*columns) % np.uint64(self.deals)).astype(np.int64)
            order = np.argsort(deal, kind="stable")
            edges = np.flatnonzero(np.diff(deal[order], prepend=-1, append=self.deals))
            numbers, blocks = [], []
            for i, j in zip(edges, edges[1:], strict=False):
                at = order[i:j]
                numbers.append(int(deal[at[0]]))
                blocks.append(_block([c[at] for c in columns], sums[at], None if strings is None else [strings[x] for x in at.tolist()]))
            for i in range(0, len(blocks), 256):
                some = blocks[i : i + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([level] * len(some), pa.int32()), pa.array(numbers[i : i + 256], pa.int32()), pa.array(some, pa.binary())],
                    names=["lang", "level", "deal", "block"],
                )
        self.held, self.size = {}, 0


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, Texts]]:
    """Slices of the texts of each language."""
    lang = batch.column("lang").dictionary_encode()
    which = lang.indices.to_numpy()
    for i, name in enumerate(lang.dictionary.to_pylist()):
        chosen = batch.column("t").filter(pa.array(which == i)) if len(lang.dictionary) > 1 else batch.column("t")
        for _, _, part in slices(texts_of(chosen)):
            yield name, part


def _merge(least: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        lang, level = key[0].as_py(), key[1].as_py()
        parts = [_unblocked(b.as_py(), level) for b in group.column("block")]
        columns, sums, first = _merged([np.concatenate([p[0][k] for p in parts]) for k in range(level)], np.concatenate([p[1] for p in parts]))
        keep = np.flatnonzero(sums >= least)
        none = pa.nulls(len(keep), pa.int64())
        codes = [pa.array(columns[k][keep].view(np.int64)) if k < level else none for k in range(3)]
        strings = [s for p in parts for s in p[2]] if level == 1 else None
        named = pa.nulls(len(keep), pa.binary()) if strings is None else pa.array([strings[i] for i in first[keep].tolist()], pa.binary())
        out = [pa.array([lang] * len(keep), pa.string()), pa.array([level] * len(keep), pa.int32()), *codes, pa.array(sums[keep]), named]
        if level == 1:  # all words of the language in this deal, rare ones too, in one row
            out = [pa.concat_arrays([a, pa.array([v], a.type)]) for a, v in zip(out, (lang, 0, None, None, None, int(sums.sum()), None), strict=True)]
        return pa.table(out, names=["lang", "level", "w1", "w2", "w3", "n", "word"])

    return run


def _counted(docs: DataFrame, fill: Callable[[_Stripes, str, Texts], None], deals: int, least: int) -> DataFrame:
    """Entries with at least ``least`` occurrences of the stripes that ``fill(stripes, lang, texts)`` fills."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = _Stripes(deals)
        for batch in batches:
            for lang, part in _by_language(batch):
                fill(stripes, lang, part)
                if stripes.size >= FULL:
                    yield from stripes.blocks()
        yield from stripes.blocks()

    return settled(docs.mapInArrow(run, _BLOCK).groupBy("lang", "level", "deal").applyInArrow(_merge(least), _ENTRY))


def _words_and_pairs(stripes: _Stripes, lang: str, part: Texts) -> None:
    code, start, end, _, whole = _phrases(part, 2)
    if not len(code):
        return
    lower = part.data.tobytes().lower()
    stripes.add(lang, [code], lambda i: lower[start[i] : end[i]])
    at = np.flatnonzero(whole)
    if len(at):
        stripes.add(lang, [code[at], code[at + 1]])


# --- field of frequent pairs --------------------------------------------------------


def _lang_code(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _bits(lang: str, w1: np.ndarray, w2: np.ndarray, size: int) -> np.ndarray:
    return (mix(_code(w1, w2) ^ _lang_code(lang), 9) % np.uint64(size)).astype(np.int64)


def _field(pairs: DataFrame, n: int) -> np.ndarray:
    """A bit for the code of each frequent pair: at most ``FIELD`` bits (32 MB) reach the driver, in pages."""
    size = PAGE
    while size < min(8 * n, FIELD):
        size *= 2
    page = PAGE // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            which = lang.indices.to_numpy()
            w1, w2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2"))
            for i, name in enumerate(lang.dictionary.to_pylist()):
                at = _bits(name, w1[which == i], w2[which == i], size)
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        pages = bits.reshape(-1, page)
        some = np.flatnonzero(pages.any(axis=1))
        for i in range(0, len(some), 256):
            numbers = some[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([pages[k].tobytes() for k in numbers], pa.binary())], names=["page", "bits"])

    def either(key: tuple, group: pa.Table) -> pa.Table:
        out = np.zeros(page, np.uint8)
        for b in group.column("bits"):
            out |= np.frombuffer(b.as_buffer(), np.uint8)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["page", "bits"])

    schema = "page long, bits binary"
    found = np.zeros((size // PAGE, page), np.uint8)
    for r in pairs.mapInArrow(run, schema).groupBy("page").applyInArrow(either, schema).collect():
        found[r["page"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return found.reshape(-1)


# --- scores -----------------------------------------------------------------------------


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) with whole numbers of up to 38 digits."""
    big = [x.cast("decimal(18,0)") for x in (a, left, right)]
    return F.call_function("div", F.lit(MILLION).cast("decimal(7,0)") * (big[0] * big[0]).cast("decimal(31,0)"), big[1] * big[2])


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Texts, with A-Z lower-cased, are split into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at blanks and
    tabs. Phrases of two or three words within a piece that occur at least ``least`` times, overlaps included, are
    candidates. Of a candidate's cuts in two the one with the lowest score counts (of equal scores the first): ``l`` and
    ``r`` are the occurrences of its parts, ``a`` those of the whole, ``n`` those of all words. A pair goes if some candidate
    of three words holds it and has at least ``share`` per cent of its occurrences. Order: score and ``a`` descending, then
    the phrase by its UTF-8 bytes.

    Null languages count as ``und``; null and empty texts have no words; no rows give none. Repeated rows count as often as
    they stand there; other columns are ignored.
    """
    clean = docs.select(column(text).cast("string").alias("t"), F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang")).where("t is not null")
    spark = docs.sparkSession
    size = clean.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    deals = max(8, -(-size // DEAL))
    short = _counted(clean, _words_and_pairs, deals, least)
    totals = short.where("level = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    single = short.where("level = 1").select("lang", F.col("w1").alias("w"), "n", F.col("word").cast("string").alias("word"))
    pairs = short.where("level = 2").select("lang", "w1", "w2", "n")
    field = spark.sparkContext.broadcast(_field(pairs, pairs.count()).tobytes())

    def triples(stripes: _Stripes, name: str, part: Texts) -> None:
        code, _, _, _, whole = _phrases(part, 3)
        at = np.flatnonzero(whole)
        if len(at):
            bits = np.frombuffer(field.value, np.uint8)

            def frequent(i: np.ndarray) -> np.ndarray:
                b = _bits(name, code[i], code[i + 1], 8 * len(bits))
                return (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1

            at = at[frequent(at)]
            at = at[frequent(at + 1)]
        if len(at):
            stripes.add(name, [code[at], code[at + 1], code[at + 2]])

    threes = _counted(clean, triples, deals, least).select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
    inside = F.explode(F.array(F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
    longest = threes.select("lang", inside.alias("p"), "a").groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    twos = pairs.join(longest, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n")))

    def part(rows: DataFrame, **names: str) -> DataFrame:
        return rows.select("lang", *[F.col(old).alias(new) for old, new in names.items()])

    def ends(rows: DataFrame, last: str) -> DataFrame:
        """With words and occurrences of the first and the last word."""
        rows = rows.join(part(single, w="w1", n="n1", word="s1"), ["lang", "w1"])
        return rows.join(part(single, w=last, n="nz", word="sz"), ["lang", last])

    two = ends(twos.withColumnRenamed("n", "a"), "w2").select(
        "lang", F.concat_ws(" ", "s1", "sz").alias("phrase"), "a", F.col("n1").alias("l"), F.col("nz").alias("r"), _score(F.col("a"), F.col("n1"), F.col("nz")).alias("score")
    )
    three = ends(threes, "w3").join(part(single, w="w2", word="s2"), ["lang", "w2"])
    three = three.join(part(pairs, w1="w1", w2="w2", n="nl"), ["lang", "w1", "w2"]).join(part(pairs, w1="w2", w2="w3", n="nr"), ["lang", "w2", "w3"])
    cuts = F.array(*[F.struct(_score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, x, y in ((1, "n1", "nr"), (2, "nl", "nz"))])
    three = three.select("lang", F.concat_ws(" ", "s1", "s2", "sz").alias("phrase"), "a", F.array_min(cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    best = two.unionByName(three).withColumn("part", spread)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = {
    "op12_collocations": r"""
with docs as (select row_number() over () d, coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
pieces as (select d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p from docs),
split as (select lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') w from pieces),
totals as (select lang, sum(len(w)) n from split group by lang),
places as (select lang, w, unnest(range(1, len(w) + 1)) i from split),
grams as (
  select lang, 1 k, w[i] p from places
  union all select lang, 2, w[i] || ' ' || w[i + 1] from places where i + 1 <= len(w)
  union all select lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from places where i + 2 <= len(w)),
f as (select lang, k, p, count(*) c from grams group by all),
candidates as (select lang, k, p, c a, string_split(p, ' ') w from f where k > 1 and c >= 10),
longer as (
  select lang, p, max(a) m from (
    select lang, w[1] || ' ' || w[2] p, a from candidates where k = 3
    union all select lang, w[2] || ' ' || w[3], a from candidates where k = 3) group by all),
left_over as (select c.* from candidates c left join longer l on c.k = 2 and c.lang = l.lang and c.p = l.p where m is null or 100 * m < 50 * a),
cuts as (
  select lang, p, a, 1 cut, w[1] x, array_to_string(w[2:], ' ') y from left_over
  union all select lang, p, a, 2, w[1] || ' ' || w[2], w[3] from left_over where k = 3),
scored as (
  select cuts.lang, cuts.p, a, cut, fx.c l, fy.c r, (cast(1000000 as hugeint) * a * a) // (cast(fx.c as hugeint) * fy.c) score
  from cuts join f fx on fx.lang = cuts.lang and fx.p = x join f fy on fy.lang = cuts.lang and fy.p = y),
lowest as (select * from scored qualify row_number() over (partition by lang, p order by score, cut) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, p) rank from lowest)
select lang, rank, p phrase, a, l, r, cast(n as bigint) n, cast(score as bigint) score from ranked join totals using (lang) where rank <= 2000
"""
}
