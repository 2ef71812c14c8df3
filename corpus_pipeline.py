"""Documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, disclosure, jaccard, language, packing
from quire.llm.tables import column, settled, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter, or far from every known language, go."""
    return language.known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id; documents without words or id stay."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data and what gives it away are replaced in their texts, and n_chars counts anew.

    A null text stays null, since there is nothing to replace.
    """
    found = disclosure.sanitise(docs)
    new = {"text": F.when(column("text").isNotNull(), F.col("clean_text")), "n_chars": F.length("clean_text").cast("long")}
    changed = F.size("base") > 0
    return found.select(*[F.when(changed, new[c]).otherwise(column(c)).alias(c) if c in new else column(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a training sequence of at most 2048 tokens."""
    return packing.pack(docs)[1]


STAGES = [
    ("language", identified),
    ("near copies", one_of_each),
    ("decontamination", decontaminated),
    ("personal data", sanitised),
    ("packing", packed),
]

#: Language vectors and token ids can't be had in SQL; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs)
    return docs
