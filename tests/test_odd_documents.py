"""Queries over error rates on documents without words or characters, next to their SQL."""

import duckdb
import pytest

from check import compare
from tonemark.queries import all_checks

ODD = [
    (1, "Một hai ba bốn năm sáu bảy tám chín mười, mười một!", "vi", "src1", 51),
    (2, "uno due tre quattro cinque sei", "it", "src2", 30),
    (3, "", "vi", "src1", 0),
    (4, None, "it", "src2", None),
    (5, "...!? \t", "vi", "src3", 7),
    (6, "two words", "it", "src4", 0),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    rows.toPandas().astype({"n_chars": "Int64"}).to_parquet(path / "documents.parquet")
    spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id long, quality int").toPandas().to_parquet(path / "labels.parquet")
    return str(path)


@pytest.mark.parametrize("key", ["ACC1", "ACC2", "ACC6", "flagship", "REC1", "REC4", "SERVICE"])
def test_rows_equal_those_of_the_sql(spark, folder, key):
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    check = all_checks()[key]
    assert compare(check.run(spark, folder).toPandas(), db.sql(check.sql).df()) == "ok"
