"""The driver's contract, with and without the subpackage that may be absent."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from textloom.operators import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("region", "nation", "part", "orders", "lineitem", "supplier", "events", "documents", "embeddings", "pages", "benchmark"):
        c.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    if name in catalogue.ORACLES:
        cursor = duck.execute(catalogue.ORACLES[name])
        order = [x[0] for x in cursor.description]
        assert sorted(order) == columns
        assert rows == sorted(repr(tuple(r[order.index(c)] for c in columns)) for r in cursor.fetchall())
    assert rows


def _equals_its_sql(spark, folder, name, documents):
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = catalogue.QUERIES[name](spark, str(folder))
    want = duckdb.connect()
    want.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(want.execute(catalogue.ORACLES[name]).fetchall())


def test_string_basics_of_empty_texts_and_nulls(spark, tmp_path):
    """The SQL has -1 as the first code point of an empty text, and true for a null."""
    texts = [None, "", "é,e", "\U0001f600e", "\0", " ", ",", "a\ufeff"]
    _equals_its_sql(spark, tmp_path, "string_basics", list(enumerate(texts)))


def test_recoded_charsets_of_close_texts(spark, tmp_path):
    """In cp850 as in mac_roman, one letter or a repeated word reads as usual: what stands farther from it tells."""
    close = ["Est les sur des et. Ç.", "Aition. Étion Étion Étion Étion Étion Étion Étion Étion la."]
    usual = ["Das ist gut. Ä."] * 20 + ["une êtion la, des êtion sur, les êtion Étage."] * 20
    rows = [(8 * i + 2, t) for i, t in enumerate(close)] + [(8 * i + 4, t) for i, t in enumerate(usual)]
    _equals_its_sql(spark, tmp_path, "recoded_charsets", rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_subpackage(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    root = __spark_entry__.__file__.rpartition("/")[0]
    subprocess.run(["cp", "-r", f"{root}/textloom", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/textloom/llm"], check=True)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), "False"], out.stderr
