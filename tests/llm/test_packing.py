import bisect
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.packing import Encoder, _full, best_fit, pack, sequences, tokenizer_path

JSON, RANKS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\r'sstlé中1२️ \xa0a!", max_size=40)))
def test_both_libraries_give_the_same_ids(text):
    want = _full(JSON).encode(text, add_special_tokens=False).ids
    assert Encoder(JSON, RANKS).ids(text.encode()).tolist() == want
    assert Encoder(JSON, None).ids(text.encode()).tolist() == want


def test_special_token_in_a_text():
    text = "a <|endoftext|>b"
    assert Encoder(JSON, RANKS).ids(text.encode()).tolist() == _full(JSON).encode(text, add_special_tokens=False).ids


def plain(lengths, capacity):
    room, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, n)
        r = room.pop(i) if i < len(room) else capacity
        bins += i >= len(room) and r == capacity and True
        bisect.insort(room, r - n)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_rules_pack_as_best_fit_decreasing_does(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 64, 2048])
    lengths = [rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 4)) for _ in range(rng.choice([1, 50, 3000]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    rules = best_fit(counts, capacity)
    used = {}
    for k, (n, rank, first, each, offset) in enumerate(rules.tolist()):
        last = rules[k + 1][1] if k + 1 < len(rules) and rules[k + 1][0] == n else counts[n]
        for r in range(rank, last):
            used.setdefault(first + (r - rank) // each, []).append((offset + (r - rank) % each * n, n))
    assert sum(map(len, used.values())) == len(lengths)
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(used) == plain(lengths, capacity)


def test_pieces_places_and_sequences(spark, documents):
    rng = random.Random(1)
    texts = [None, "", "x", "same", "same", "<|endoftext|> é中", "word " * 9000, "many " * 2047]
    texts += [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(900))) for _ in range(40)]
    docs = documents(texts).withColumnRenamed("source", "piece")
    cut, places = pack(docs)
    rows = places.toPandas()
    for doc_id, own in rows.groupby("doc_id"):
        ids = np.array([*_full(JSON).encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(own.sort_values("piece").itertuples()):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= 2048 and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert rows.doc_id.nunique() == len(texts)
    for r in sequences(cut).collect():
        own = rows[rows.sequence_id == r.sequence_id].sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and len(r.ids) == 4 * own.length.sum() <= 8192
    again, _ = pack(documents([(1, "a b", "en"), (1, "a b", "en"), (1, "c", "en"), (None, "d", "en"), (None, None, "en")]))
    found = sequences(again).collect()
    assert sorted(str(i) for r in found for i in r.doc_ids) == ["1", "1", "1", "None", "None"]
    assert sum(len(r.ids) for r in found) == 4 * sum(r.length for r in again.select("length").collect())
    assert pack(documents([]))[1].count() == 0
    assert [r.length for r in pack(documents([(None, None, None)]))[1].collect()] == [1]
