"""Words, shingles and their 64-bit codes for whole Arrow batches, in numpy.

Everything here runs inside a task on one slice of a batch (about ``SLICE_BYTES`` of text, or one text that is longer).
A word is a run of bytes of a byte class; bytes above 0x7F are part of words, so UTF-8 text needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # each byte takes some 60 on the way to codes

_P = 0x9E3779B97F4A7C13  # odd, and 3 modulo 8: neighbours that change places keep different codes
_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-spread 64-bit code of each 64-bit number (the splitmix64 step)."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(256, dtype=np.uint64), 11)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: the bytes in these inclusive ranges are part of words."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Words between ASCII white space.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def _power(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        known = _powers[base] = np.multiply.accumulate(full)
    return known[:n]


@dataclass
class Texts:
    """Some texts as one byte array; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``, nulls are empty."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string column, without copying them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(bytes_[starts[0] : starts[-1]], starts - starts[0])


def slices(texts: Texts, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive texts of together about ``limit`` bytes: (first, last + 1, their texts)."""
    first, n = 0, len(texts)
    while first < n:
        last = int(np.searchsorted(texts.offsets, texts.offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        start, end = texts.offsets[first], texts.offsets[last]
        yield first, last, Texts(texts.data[start:end], texts.offsets[first : last + 1] - start)
        first = last


@dataclass
class Words:
    """Words of some texts in order: byte range, code, and for each text its range of words."""

    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i]:bounds[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(texts: Texts, kind: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Words of each text. Equal words have equal codes; different ones differ but for chance of 64 bits."""
    data, n = texts.data, len(texts.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(texts) + 1, np.int64))
    inside = kind[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = texts.offsets[:-1][texts.offsets[:-1] < n]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = texts.offsets[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    values = _CODES[_LOWER] if lower else _CODES
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[data] * _power(_P, n), out=total[1:])
    code = mix((total[end] - total[start]) * _power(_INVERSE, n)[start] + (end - start).astype(np.uint64))
    bounds = np.searchsorted(start, texts.offsets)
    return Words(start, end, code, bounds)


def runs(bounds: np.ndarray, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``n`` consecutive words: first word, number of words, and bounds of each text's windows.

    With ``whole``, a text of fewer words, but not none, is one window.
    """
    counts = np.diff(bounds)
    per = np.maximum(counts - n + 1, (counts > 0).astype(np.int64) if whole else 0)
    edges = np.concatenate([[0], np.cumsum(per)])
    first = np.arange(edges[-1]) - np.repeat(edges[:-1] - bounds[:-1], per)
    return first, np.minimum(n, np.repeat(counts, per)), edges


def window_codes(code: np.ndarray, first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """One code for each window, of its words in order and their number."""
    out = length.astype(np.uint64)
    for k in range(n):
        at = np.minimum(first + k, max(len(code) - 1, 0))
        out = mix(out + (np.where(k < length, code[at], np.uint64(0)) if len(code) else np.uint64(0)), k)
    return out


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values (codes of 64 bits) of each group in ascending order, and the bounds of the groups."""
    n = len(bounds) - 1
    group = np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds))
    # a group's number and the upper bits of a code in one number: sorted several times faster than by both
    bits = np.uint64(max(1, n.bit_length()))
    order = np.argsort((group << (np.uint64(64) - bits)) | (values >> bits))
    same = group[1:] == group[:-1]
    ordered = values[order]
    if (same & (ordered[1:] < ordered[:-1])).any():  # codes that differ in lower bits only
        ordered = values[np.lexsort((values, group))]
    keep = np.ones(len(values), bool)
    keep[1:] = (ordered[1:] != ordered[:-1]) | ~same
    return ordered[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
