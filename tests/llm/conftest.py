import pytest


@pytest.fixture
def frame(spark):
    """Rows of documents as a DataFrame over several partitions, with columns whose names clash."""

    def make(rows, schema="doc_id long, text string, lang string, source string", parts=3):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema).repartition(parts)
        for name in ("h", "row", "key", "_n", "kept", "score", "secrets", "n_words"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
