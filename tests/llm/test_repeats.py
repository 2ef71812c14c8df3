"""Repeated lines and passages against plain Python."""

import random
import re

import pyarrow as pa
import pytest

from quire.llm.paragraphs import _numbers, bands, passages, without_repeats
from quire.llm.paragraphs import repeated as repeated_lines
from quire.llm.suffixes import repeated as repeated_passages

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def words(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def test_passages_agree_with_plain_windows(spark, documents):
    rng = random.Random(8)
    shared = [words(rng, n) for n in (49, 50, 51, 70, 200)]
    texts = [None, "", "short", words(rng, 60), "loop " * 300]
    for _ in range(30):
        parts = [words(rng, rng.randrange(80))]
        for p in rng.sample(shared, 2):
            parts += [p.upper() if rng.random() < 0.3 else p, words(rng, rng.randrange(40))]
        texts.append(" ".join(parts))
    texts += [texts[9], texts[9], shared[4], shared[0], shared[0]]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, shared[4], "en")]
    got = {}
    for r in repeated_passages(documents(rows, 5)).collect():
        assert r.doc_id is not None and r.n_docs == sum(split(t) == split(texts[r.doc_id]) for t in texts)
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    seen, want = {}, {}
    for t in texts:
        w = split(t)
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])] = seen.get(tuple(w[i : i + 50]), 0) + 1
    for k, t in enumerate(texts):
        w = split(t)
        marked = {p for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] > 1 for p in range(i, i + 50)}
        if marked:
            want[k] = marked
    assert got == want
    assert repeated_passages(documents([])).count() == 0


@pytest.mark.parametrize("batch", [7, 1000])
def test_partners_that_are_no_neighbours_are_found(spark, documents, batch):
    """A common block of 40 words after a header of 12, before other words: partners lie anywhere among all that have the block."""
    block, heads = " ".join(f"c{i}" for i in range(40)), [" ".join(f"h{k}x{i}" for i in range(12)) for k in range(50)]
    texts = [f"{' '.join(f'u{i}a{j}' for j in range(20 + i % 9))} {heads[i % 50]} {block} {' '.join(f't{i}b{j}' for j in range(60))}" for i in range(600)]
    alone = f"{' '.join(f'v{j}' for j in range(40))} {block} {' '.join(f'z{j}' for j in range(40))}"  # 40 common words are too few
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = sorted((r.doc_id, r.start_word, r.end_word) for r in repeated_passages(documents([*texts, alone], 5)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == [(i, 20 + i % 9, 72 + i % 9) for i in range(600)]


def test_lines_agree_with_all_pairs(spark, documents):
    rng = random.Random(9)
    base = [words(rng, n) for n in (20, 25, 60, 120)]

    def near(line, n):
        w = line.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        return " ".join(w)

    texts = [None, "", "\n\n", "too short to count\ntoo short to count"]
    for k in range(24):
        lines = [words(rng, 30), near(base[k % 4], k % 3 if k % 4 > 1 else 0), "é " + words(rng, 22)]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [texts[5], "a line twice " * 8 + "\n" + "a line twice " * 8]
    docs = documents(texts)
    lines = [(i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in re.finditer(r"[^\n]+", t or "") if len(split(m[0])) >= 20]
    sets = [frozenset(tuple(split(x[3])[k : k + 5]) for k in range(len(split(x[3])) - 4)) for x in lines]
    label = list(range(len(lines)))
    changed = True
    while changed:
        changed = False
        for a in range(len(lines)):
            for b in range(a):
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    want = set()
    for k, x in enumerate(lines):
        same = [lines[j] for j in range(len(lines)) if label[j] == label[k]]
        if len(same) > 1:
            first = min(s[:2] for s in same)
            want.add((first[0], *x[:3], x[:2] == first))
    got = [tuple(r) for r in repeated_lines(docs).select("component_id", "doc_id", "start", "end", "kept").collect()]
    assert len(got) == len(want) and set(got) == want
    gone = {(d, s, e) for _, d, s, e, kept in got if not kept}
    for r in without_repeats(docs).collect():
        t = texts[r.doc_id]
        expect = None if t is None else "".join(t[m.start() : m.end()] for m in re.finditer(r"[^\n]*\n?", t) if (r.doc_id, m.start(), m.start() + len(m[0].rstrip("\n"))) not in gone)
        assert r.text == expect
    assert repeated_lines(documents([])).count() == 0 and bands() == 8


def test_lines_of_five_words_and_more_are_compared(spark, documents):
    rng = random.Random(10)
    five, wrapped = words(rng, 5), [words(rng, 12) for _ in range(5)]
    near = " ".join([*wrapped[4].split(), "tail"])  # 8 of 9 shingles
    texts = [f"{words(rng, 9)}\n{five}\n" + "\n".join(wrapped), f"{five.upper()}\n{words(rng, 14)}", "\n".join([*wrapped[:4], near]), "only four words here\nonly four words here"]
    got = {(r.doc_id, texts[r.doc_id][r.start : r.end], r.kept) for r in repeated_lines(documents(texts)).collect()}
    want = {(0, five, True), (1, five.upper(), False)} | {(0, w, True) for w in wrapped} | {(2, w, False) for w in [*wrapped[:4], near]}
    assert got == want


def test_lines_of_null_ids_long_texts_repeated_rows_and_clashing_names(spark, documents):
    line = "one two three four five six"
    long = "\n".join(["x y z u v w"] * 5000)
    rows = [(1, f"{line}\nown", "en"), (2, f"{line}\nmine", "en"), (2, f"{line}\nmine", "en"), (None, line, "en"), (3, None, "en"), (4, long, "en")]
    docs = documents(rows).withColumnsRenamed({"source": "gone_id", "lang": "Gone_Lines", "n_chars": "__gone"})
    got = without_repeats(docs)
    assert got.columns == docs.columns
    found = sorted((str(r.doc_id), str(r.text)) for r in got.collect())
    assert found == sorted([("1", f"{line}\nown"), ("2", "mine"), ("2", "mine"), ("None", line), ("3", "None"), ("4", "x y z u v w\n")])


def plain_passages(texts, least):
    """Units by regular expressions (no sentence over 32 words), all pairs of sets, stretches by a walk."""
    units = []
    for i, t in enumerate(texts):
        at, own = 0, []
        for part in re.split(r"((?<=[.!?])[\x20\x09-\x0D]+|(?<=[.!?]['\")\]])[\x20\x09-\x0D]+|[\x20\x09\x0B-\x0D]*\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*)", t or ""):
            if split(part):
                own.append((i, at + len(part) - len(part.lstrip()), at + len(part.rstrip()), split(part)))
            at += len(part)
        units.append(own)
    flat = [u for own in units for u in own]
    sets = [frozenset(tuple(u[3][k : k + 5]) for k in range(max(1, len(u[3]) - 4))) for u in flat]
    label, changed = list(range(len(flat))), True
    while changed:
        changed = False
        for a in range(len(flat)):
            for b in range(a):
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    found, place = [], 0
    for own in units:
        runs = [[]]
        for k, u in enumerate(own):
            if label.count(label[place + k]) > 1:
                runs[-1].append((label[place + k], u))
            else:
                runs.append([])
        place += len(own)
        found += [(c, u, run[0][1][1]) for run in runs if sum(len(u[3]) for _, u in run) >= least for c, u in run]
    first = {}
    for c, u, _ in found:
        first[c] = min(first.get(c, u[:2]), u[:2])
    return {(first[c][0], *u[:3], u[:2] == first[c], start) for c, u, start in found}


def test_passages_agree_with_all_pairs_of_sentences(spark, documents):
    rng = random.Random(11)

    def sentence(n):
        return words(rng, n).capitalize() + rng.choice([".", "!", "?", '."'])

    def wrapped(t, width):
        w = t.split(" ")
        return "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))

    shared = [[sentence(rng.choice([1, 2, 4, 7, 9, 14, 25])) for _ in range(8)] for _ in range(5)]
    texts = [None, "", "  \n\n ", "Short. Short. Short."]
    for k in range(25):
        own = [sentence(rng.randrange(1, 20)) for _ in range(3)]
        some = list(shared[k % 5])
        if k % 3 == 1:
            some[5] = f"Also {some[5]}"  # a near copy if it is long, a gap if not
        texts.append(wrapped(" ".join(own[:2]), 9) + rng.choice([" ", "\n\n", "\n"]) + wrapped(" ".join(some), 5 + k % 7) + " " + own[2])
    texts += ["É ü: ein Wort. " + texts[7], "No mark at its end\n\n" + texts[9], texts[9]]
    for least in (20, 40):
        got = [tuple(r) for r in passages(documents(texts, 5), least=least).select("component_id", "doc_id", "start", "end", "kept", "passage").collect()]
        want = plain_passages(texts, least)
        assert len(want) > 100 and len(got) == len(want) and set(got) == want
    assert passages(documents([])).count() == 0


def test_passages_across_lines_are_found_and_short_common_lines_are_not(spark, documents):
    rng = random.Random(12)
    passage = words(rng, 80).split()  # no marks: cut where its words say
    wrap = [" ".join(passage[:40]) + "\n" + " ".join(passage[40:]), "\n".join(" ".join(passage[i : i + 4]) for i in range(0, 80, 4))]
    line = "all of this is free to use"
    texts = [f"{words(rng, 30)} {wrap[0]} {words(rng, 20)}", f"{words(rng, 11)}.\n{wrap[1]}\n{words(rng, 50)}", f"{line}\n\n{words(rng, 60)}", f"{words(rng, 60)}\n\n{line}"]
    rows = [*enumerate(texts), (None, texts[0]), (4, texts[2]), (4, words(rng, 70))]
    docs = documents([(i, t, "en") for i, t in rows])
    found = {}
    for r in passages(docs).collect():
        t = texts[r.doc_id] if r.doc_id < 4 else texts[2]
        found.setdefault(r.doc_id, []).extend(t[r.start : r.end].split())
    assert set(found) == {0, 1, 2, 4} and set(found[0]) == set(found[1]) <= set(passage) and len(found[0]) >= 40
    assert sorted(found[2]) == sorted(found[4]) == sorted(texts[2].split())


def test_sets_that_link_share_one_of_their_least_values():
    rng = random.Random(13)
    for _ in range(20000):
        common = [rng.random() for _ in range(rng.randrange(1, 40))]
        a, b = (sorted(common + [rng.random() for _ in range(rng.randrange(0, 9))]) for _ in range(2))
        if a != b and 100 * len(common) >= 80 * (len(a) + len(b) - len(common)):
            assert min(len(a), len(b)) >= 4 and set(a[: len(a) // 5 + 1]) & set(b[: len(b) // 5 + 1])


def test_only_units_that_may_be_in_passages_are_written(spark, documents, tmp_path, monkeypatch):
    rng = random.Random(14)
    shared = " ".join(f"{words(rng, 12)}." for _ in range(4))
    texts = [" ".join(f"{words(rng, 12)}." for _ in range(20)) for _ in range(100)]
    texts[7] += f" {shared}"
    texts[50] += f" {shared}"
    monkeypatch.setattr("quire.llm.tables.checkpoint_dir", lambda _: str(tmp_path))
    assert passages(documents(texts)).count() == 8
    written = sum(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir())
    assert written < 200  # of 2,008 units


def test_passages_do_not_depend_on_batches(spark, documents):
    rng = random.Random(15)
    shared = [" ".join(f"{words(rng, rng.choice([2, 5, 9, 14]))}." for _ in range(7)) for _ in range(3)]
    texts = [f"{words(rng, 11)}. {shared[k % 3]} {words(rng, 7)}. {shared[k % 2]}" for k in range(8)]
    texts += texts[3:5]
    twice = [*((i, t, "en") for i, t in enumerate(texts)), (3, texts[3], "en"), (3, texts[5], "en")]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def found(rows):
        return sorted(tuple(r) for r in passages(documents(rows, 2)).select("component_id", "doc_id", "start", "end", "kept", "passage").collect())

    old, want = spark.conf.get(name), found(twice)
    spark.conf.set(name, "1")
    try:
        assert found(texts) == sorted(plain_passages(texts, 40)) and found(twice) == want
    finally:
        spark.conf.set(name, old)


def test_numbers_of_part_of_an_array():
    sets = [list(range(k, 2 * k)) for k in range(12)]
    made = pa.array([b"".join(x.to_bytes(8, "little") for x in one) for one in sets], pa.binary())
    for first, n in ((0, 12), (0, 1), (5, 4), (11, 1), (12, 0)):
        values, bounds = _numbers(made.slice(first, n))
        assert [values[i:j].tolist() for i, j in zip(bounds, bounds[1:])] == sets[first : first + n]
