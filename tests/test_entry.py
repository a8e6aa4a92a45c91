"""The driver contract, and a few queries of each kind next to their SQL at the smallest scale."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def load(name):
    spec = importlib.util.spec_from_file_location(name, ROOT / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


contract, check = load("__spark_entry__"), load("check")


def test_entry_has_rows_and_a_fixed_schema(spark):
    got = contract.entry(spark)
    assert got.columns[:4] == ["lang", "model", "n_pairs", "wer"] and got.count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize(
    "key", ["TXT1", "TXT3", "ACC3", "LAT2", "STAT1_large", "TQ_all", "INT4", "SET7", "SEG1", "GATE2", "SRC3"]
)
def test_query_equals_sql(spark, db, key):
    got = contract.queries()[key](spark, SF).toPandas()
    assert len(got) and check.compare(got, db.sql(contract.oracle_sql()[key]).df()) == "ok"
