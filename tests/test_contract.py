import os

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracle import compare, database

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


def test_entry_gives_a_verdict_per_document(spark):
    assert contract.entry(spark).columns == ["doc_id", "errors", "warnings", "passed"]


def test_every_query_has_sql():
    assert set(contract.NAMES) <= set(contract.queries()) and set(contract.NAMES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", contract.NAMES)
def test_query_agrees_with_sql(spark, db, name):
    assert compare(spark, db, FOLDER, name, contract.queries()[name], contract.oracle_sql()[name]) is None


def test_metadata_findings_agree_on_documents_without_characters_or_source(spark, tmp_path):
    rows = [(i, "", lang, source, n) for i, (lang, source, n) in enumerate(
        (lang, source, n) for lang in ("en", "de", "fr", "es", None) for source, n in (("s", 5), ("s", 0), ("s", None), (None, 0), ("TODO: # '\n-", 3))
    )]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    small = duckdb.connect()
    small.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    name = "metadata_findings"
    assert compare(spark, small, str(tmp_path), name, contract.queries()[name], contract.oracle_sql()[name]) is None
