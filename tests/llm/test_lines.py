from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from quire.llm import lines
from quire.llm.lines import LineIndex, PerfectHash, line_index, without_common_lines

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, least, length):
    split = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(BLANK).translate(LOWER) for x in s] for s in split]
    n = Counter(k for ks in keys for k in set(ks))
    out = []
    for t, s, ks in zip(texts, split, keys, strict=True):
        kept = [x for x, k in zip(s, ks, strict=True) if not (len(k) >= max(length, 1) and n[k] >= least)]
        out.append((None if t is None else "\n".join(kept), len(s), len(s) - len(kept)))
    return out


def texts():
    rng = np.random.default_rng(5)
    pool = [f"Line {i} of a common block" for i in range(40)] + ["é", "  É\t", "A", "\x0bfoot\x0c", "", "   "]
    made = ["\n".join(pool[int(j) % len(pool)] if j < 80 else f"own {i} {j}" for j in rng.zipf(1.3, size=rng.integers(0, 12))) for i in range(120)]
    made += [None, None, "", "\n", "\n\n\n", "FOOT", " foot ", "foot\r"] + ["whole text\nrepeats"] * 12
    return made + ["\n".join(["own line"] * 3 + ["Line 3 of a common block"] * 50000)]


@pytest.mark.parametrize("least, length, shard, portion, held", [(10, 1, 1 << 15, 64, 1 << 19), (3, 2, 8, 2, 16), (1, 1, 8, 1, 16)])
def test_agrees_with_plain_python(spark, documents, monkeypatch, least, length, shard, portion, held):
    monkeypatch.setattr(lines, "SHARD", shard)
    monkeypatch.setattr(lines, "PORTION", portion)
    monkeypatch.setattr(lines, "HELD", held)
    rows = texts()
    docs = documents(rows).withColumnRenamed("source", "N_Lines").withColumnRenamed("lang", "a b.c`d")
    got = without_common_lines(docs, least=least, length=length)
    assert got.columns == ["doc_id", "text", "a b.c`d", "n_chars", "n_lines", "n_dropped"]
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()}
    assert [found[i] for i in range(len(rows))] == plain(rows, least, length)


def test_an_index_of_other_documents(spark, documents):
    known = line_index(documents(["a\nb", "A\nc", "a"]), least=2)
    got = without_common_lines(documents(["a\nb\nc"]), index=known).first()
    assert (got.text, got.n_lines, got.n_dropped) == ("b\nc", 3, 1)


def test_repeated_rows_null_ids_and_no_rows(spark, documents):
    docs = documents([(None, "x\ny", "en"), (1, "x", "en"), (1, "x", "en")])
    got = without_common_lines(docs, least=3).collect()
    assert sorted((str(r.doc_id), r.text, r.n_dropped) for r in got) == [("1", "", 1), ("1", "", 1), ("None", "y", 1)]
    assert without_common_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash_is_minimal_and_knows_its_keys(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 1 << 62, (2, n)).astype(np.uint64)
    if n > 1:
        a[1] = a[0]  # half a code may repeat
    hashed = PerfectHash.build(a, b)
    assert sorted(hashed.slots(a, b).tolist()) == list(range(n))
    assert 8 * len(hashed.bits) <= 5 * n + 64 * len(hashed.sizes)
    other = hashed.slots(a + np.uint64(1), b)
    assert ((other >= -1) & (other < max(n, 1))).all()


def test_no_index_counts_nothing():
    keys = np.zeros(3, lines._WIDE)
    assert LineIndex([], 1, 10, 1).counts(keys).tolist() == [0, 0, 0]


def test_query_digests_the_kept_lines(spark, tmp_path, documents):
    rows = ["Top\nmine %d" % i for i in range(10)] + [None]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lines.op13_lines(spark, str(tmp_path)).collect()}
    assert got[4].kept_sha256 == sha256(b"mine 4").hexdigest() and (got[4].n_lines, got[4].n_dropped) == (2, 1)
    assert got[10].kept_sha256 == sha256(b"").hexdigest() and (got[10].n_lines, got[10].n_dropped) == (1, 0)
