import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.words import ALNUM, SPACED, distinct, runs, slices, texts_of, window_codes, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = {"spaced": (SPACED, r"[^\x20\x09-\x0D]+"), "alnum": (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé ß1\n\t.-中 ", max_size=30)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.sampled_from(sorted(PATTERNS)))
def test_words_are_those_of_the_pattern(texts, which):
    kind, pattern = PATTERNS[which]
    part = texts_of(pa.array(texts, pa.string()))
    found = words(part, kind)
    want = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
    got = [bytes(part.data[s:e]).decode().translate(LOWER) for s, e in zip(found.start, found.end)]
    assert got == [w for ws in want for w in ws]
    assert found.counts.tolist() == [len(w) for w in want]
    codes = {}
    assert all(codes.setdefault(w, c) == c for w, c in zip(got, found.code.tolist()))
    assert len(set(codes.values())) == len(codes)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_windows_have_one_code_for_each_sequence(texts, n):
    found = words(texts_of(pa.array(texts, pa.string())), SPACED)
    first, length, edges = runs(found.bounds, n)
    values, bounds = distinct(window_codes(found.code, first, length, n), edges)
    for i, t in enumerate(texts):
        ws = (t or "").translate(LOWER)
        ws = re.findall(r"[^\x20\x09-\x0D]+", ws)
        want = {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()
        assert bounds[i + 1] - bounds[i] == len(want)
        assert (np.diff(values[bounds[i] : bounds[i + 1]].astype(object)) > 0).all()


def test_slices_cover_all_texts_and_sliced_arrays():
    whole = pa.array(["x", None, "ab cd", "é" * 50, "", "end"], pa.string())
    for column in (whole, whole.slice(2, 3)):
        texts = texts_of(column)
        joined = [bytes(p.data[p.offsets[k] : p.offsets[k + 1]]).decode() for _, _, p in slices(texts, 4) for k in range(len(p))]
        assert joined == [x or "" for x in column.to_pylist()]


def test_codes_that_differ_in_lower_bits_only_stay_apart():
    values = np.array([9, 7, 9, 8, 1 << 63, 5, 5, (1 << 63) + 1, 1 << 63], np.uint64)
    got, bounds = distinct(values, np.array([0, 5, 5, 9]))
    assert got.tolist() == [7, 8, 9, 1 << 63, 5, 1 << 63, (1 << 63) + 1] and bounds.tolist() == [0, 4, 4, 7]
    got, bounds = distinct(np.zeros(0, np.uint64), np.zeros(3, np.int64))
    assert len(got) == 0 and bounds.tolist() == [0, 0, 0]
