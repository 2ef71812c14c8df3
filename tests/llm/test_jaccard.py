import random
import re

import numpy as np
import pytest

from quire.llm import jaccard
from quire.llm.jaccard import folded, one_of_each, possible, shortest, signatures, similar, sketches
from quire.llm.words import mix
import pyarrow as pa

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    comp = {i: i for i in texts}
    ids = sorted(texts)
    for _ in ids:
        before = dict(comp)
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    return {i: (len(sets[i]), comp[i]) for i in ids}


def family(rng, size, copies, most):
    base = [f"v{rng.randrange(5000)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = base[:]
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [128, 2])
def test_agrees_with_all_pairs(spark, documents, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(block)
    texts = [None, "", " \n ", "one", "ONE", "one two three four", "one two three  four", "é à"]
    for size in (4, 5, 6, 7, 9, 12, 14, 20, 30, 60, 150, 400):
        texts += family(rng, size, 8, max(1, size // 30 + 1))
    shared = " ".join(f"s{i}" for i in range(40))  # a passage that many texts share without being similar
    texts += [f"{shared} " + " ".join(f"q{rng.randrange(9999)}" for _ in range(rng.randrange(5, 25))) for _ in range(25)]
    texts += [texts[20]] * 5
    got = similar(documents(texts)).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(dict(enumerate(texts)))


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for size in [*range(1, 40), 77, 150, 333, 900]:
        a = mix(np.arange(size), int(rng.integers(1000)))
        for most in (size, max(1, size - 1)):
            # the farthest sets of size b that still link: the larger one holds the smaller, or both lose alike
            for b in range(-(-8 * size // 10), size * 10 // 8 + 1):
                inter = -(-4 * (size + b) // 9)
                if inter > min(size, b):
                    continue
                other = np.concatenate([rng.permutation(a)[:inter], mix(np.arange(b - inter), 77)])
                values = np.concatenate([np.sort(a), np.sort(other)])
                sig, which = signatures(values, np.array([0, size, size + b]))
                assert set(sig[which == 0]) & set(sig[which == 1]), (size, b)


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for size in (1, 5, 16, 64, 300, 3000):
        a = mix(np.arange(size), size)
        for lost in {0, size // 20, size // 9}:
            b = np.concatenate([a[lost:], mix(np.arange(lost), 99)])
            s = sketches(np.concatenate([a, b]), np.array([0, size, size + len(b)]))
            cells = min(len(x.as_buffer()) for x in s)
            apart = int(np.bitwise_count(folded(s[0], cells) ^ folded(s[1], cells)).sum())
            assert apart <= 2 * lost
            if 100 * (size - lost) >= 80 * (size + lost):
                assert possible(np.array([size]), np.array([size]), np.array([apart]))[0]


def test_null_ids_and_repeated_rows(spark, documents):
    rows = [(None, "a b c d e f", "en"), (3, "a b c d e f", "en"), (3, "a b c d e f", "en"), (1, "a b c d e f", "en"), (2, None, "en")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar(documents(rows)).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 1), (3, 2, 1), (1, 2, 1), (2, 0, 2)], key=str)
    kept = one_of_each(documents(rows).withColumnRenamed("source", "component_id"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, None]
    assert similar(documents([])).count() == 0


@pytest.mark.parametrize("first", [0, 1, 7, 30])
def test_shortest_sketches_of_part_of_an_array(first):
    rng = random.Random(first)
    sizes = [rng.randrange(1, 200) for _ in range(30)]
    values = np.array([rng.getrandbits(64) for _ in range(sum(sizes))], np.uint64)
    made = sketches(values, np.concatenate([[0], np.cumsum(sizes)]))
    for part in (made.slice(first), made.slice(first, 9)):
        length, code = shortest(part)
        assert length.tolist() == [len(x.as_py()) for x in part]
        assert code.tolist() == [int(folded(x, 8).view(np.uint64)[0]) for x in part]
