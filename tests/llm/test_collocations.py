import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import collocations as C
from quire.llm.collocations import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, share, top):
    """(text, lang) rows by the rule, phrase by phrase."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        if len(p) == 2 and any(len(q) == 3 and m == lang and p in (q[:2], q[1:]) and 100 * b >= share * a for (m, q), b in found.items()):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def rows():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "New", "york", "city", "é", "É", "naïve", "x", "𝔸", "\x0bz", "b c", "a-b", "I", "i"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    made = []
    for i in range(160):
        words = rng.choice(vocabulary, size=rng.integers(0, 40), p=weights / weights.sum())
        marks = rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "!?"], size=len(words))
        made.append(("".join(w + m for w, m in zip(words, marks, strict=True)), ["en", "de", None, "und"][i % 4]))
    made += [(None, "en"), ("", "fr"), (" \t\n.", "fr"), ("a a a a a a a a a a a a a", "rep"), ("p q r\n" * 12 + "p q\n" * 13, "half"), ("p q r\n" * 12 + "p q\n" * 12, "half2")]
    return made + [("new york city " * 30000, "long")] + [("one two three four", "same")] * 12


@pytest.mark.parametrize("least, full, deal, field", [(10, 1 << 21, 8 << 20, 1 << 28), (2, 200, 1 << 12, 1 << 13)])
def test_agrees_with_the_rule(spark, documents, monkeypatch, least, full, deal, field):
    for name, value in (("FULL", full), ("DEAL", deal), ("FIELD", field)):
        monkeypatch.setattr(C, name, value)
    made = rows()
    docs = documents([(i, t, lang) for i, (t, lang) in enumerate(made)]).withColumnRenamed("source", "Phrase").withColumnRenamed("n_chars", "rank")
    got = collocations(docs, least=least, top=50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(made, least, 50, 50)


def test_ties_are_cut_at_the_top(spark, documents):
    made = [("b c. a c. a b. d d d", "en")] * 10
    got = collocations(documents([(i, t, x) for i, (t, x) in enumerate(made)]), top=2)
    assert sorted(map(tuple, got.collect())) == plain(made, 10, 50, 2)


def test_no_rows(spark, documents):
    assert collocations(documents([]), least=1).count() == 0
    assert collocations(documents([None, ""]), least=1).count() == 0


def test_exact_beyond_64_bits(spark):
    a, left, right = 10**12 - 1, 10**12 + 7, 10**12 + 3
    row = spark.range(1).selectExpr(f"{a}L a", f"{left}L l", f"{right}L r")
    assert row.select(C._score(row["a"], row["l"], row["r"])).first()[0] == 1000000 * a * a // (left * right)


def test_phrases_whose_codes_collide_stay_apart(monkeypatch):
    monkeypatch.setattr(C, "_code", lambda *parts: np.zeros(len(parts[0]), np.uint64))
    columns = [np.array(x, np.uint64) for x in ([1, 2, 1, 1], [5, 5, 6, 5])]
    found, sums, _ = C._merged(columns, np.array([1, 10, 100, 1000]))
    assert sorted(zip(found[0].tolist(), found[1].tolist(), sums.tolist(), strict=True)) == [(1, 5, 1001), (1, 6, 100), (2, 5, 10)]
