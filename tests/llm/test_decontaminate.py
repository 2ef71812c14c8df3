import hashlib
import random
import re

import numpy as np
import pytest

from quire.llm import decontaminate
from quire.llm.decontaminate import FmIndex, clean, contamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ws(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    w, hit, ids = ws(text), set(), set()
    for item, t in items:
        i = ws(t)
        for s in range(max(1, len(i) - 12) if i else 0):
            win = i[s : s + 13]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    ids.add(str(item) if item is not None else "")
    return len(w), len(hit), sorted(ids), hit


@pytest.mark.parametrize("size,sigma", [(0, 3), (1, 3), (300, 3), (500, 40)])
def test_index_finds_every_occurrence(size, sigma):
    rng = np.random.default_rng(size)
    text = rng.integers(1, sigma, size)
    index = FmIndex(text, sigma)
    phrases = rng.integers(1, sigma, (60, 4))
    lengths = rng.integers(1, 5, 60)
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high):
        want = [i for i in range(size - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def cases():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "ÉA", "the"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 12, 13, 14, 30])))) for i in range(12)]
    items += [(90, None), (91, ""), (92, "... --"), (None, "lone words here"), (5, "the same id again"), (93, items[0][1])]
    texts = [None, "", "  ..", "The"]
    for _ in range(25):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(40)))]
        for _, t in rng.sample(items, 3):
            parts.append((t or "").upper() if rng.random() < 0.5 else (t or ""))
            parts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(5))))
        texts.append(", ".join(parts))
    return texts + [texts[7], "x " * 30000 + items[3][1]], items


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_agrees_with_plain_search(spark, documents, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    texts, items = cases()
    docs = documents(texts).withColumnRenamed("source", "items")
    got = contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        n, n_hit, ids, hit = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, n_hit, ids), r.doc_id
        covered = {k for k, m in enumerate(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").translate(LOWER))) for s in r.removal if s.start <= m.start() and m.end() <= s.end}
        assert covered == hit


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(documents(["a b", None]), none).collect()] == [0, 0]
    assert contamination(documents([]), none).count() == 0


def test_only_contaminated_documents_go(spark, documents):
    passage = " ".join(f"p{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = documents(["clean text", passage, "much other text " * 200 + passage, None])
    kept = clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_digest_lists_items_as_text():
    assert hashlib.sha256(b"10,9").hexdigest() == hashlib.sha256(",".join(sorted(["9", "10"])).encode()).hexdigest()
