"""The pipeline against its stages in plain Python, on a small folder of tables."""

import random
import re
import zlib

import numpy as np

import corpus_pipeline
import test_decontaminate
import test_disclosure
import test_jaccard
from quire.llm.packing import _full, tokenizer_path

EN = "the and of to in that it was for with this from have not are".split()
FR = "le la les des une dans pour que qui sur avec pas est nous ils".split()


def tables(spark, folder):
    rng = random.Random(12)
    passage = " ".join(f"bench{i}" for i in range(16))

    def text(lang, n):
        return " ".join(rng.choice(EN if lang == "en" else FR) + rng.choice(["", "er", "ing", "tion", ""]) for _ in range(n))

    rows = []
    for k in range(60):
        lang = "en" if k % 2 else "fr"
        rows.append([k, text(lang, 30 + k), lang, f"s{k % 5}"])
    rows[7][1] += " " + passage
    rows[8][1] += " mail me at someone@corp.example or +49 30 1234567"
    rows += [[60, rows[9][1], "en", "s1"], [61, rows[9][1] + " more", "en", "s1"], [62, None, "en", "s1"], [63, "12 34 !!", None, "s1"], [64, rows[10][1] * 60, "fr", None]]
    docs = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {d[0]: d for d in docs}, [(1, passage), (2, None)]


def test_stages_take_effect_one_after_another(spark, tmp_path):
    docs, items = tables(spark, str(tmp_path))
    rows = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    left = {i: d[1] for i, d in docs.items() if d[1] and re.search(r"[^\W\d_]", d[1])}
    left = {i: t for i, t in left.items() if test_jaccard.brute(left)[i][1] == i}
    assert 9 in left and 60 not in left and 61 not in left
    counted = {i: test_decontaminate.brute(t, items) for i, t in left.items()}
    left = {i: t for i, t in left.items() if not (counted[i][1] and 20 * counted[i][1] >= counted[i][0])}
    assert 7 not in left and {r["doc_id"] for r in rows} == set(left)
    tokens = _full(tokenizer_path("byte_bpe_50k.json"))
    for i, t in left.items():
        for kind, start, end, _ in sorted(test_disclosure.brute(t), key=lambda s: -s[1]):
            t = f"{t[:start]}[{kind.upper()}]{t[end:]}"
        ids = np.array([*tokens.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


def test_every_stage_but_the_last_keeps_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
