import pytest
from pyspark.sql import functions as F

CLASHING = ("kept", "n_words", "text_", "_row", "label", "u", "node", "n")


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) pairs, with other columns whose names operators use themselves."""

    def build(rows, **more):
        df = spark.createDataFrame([(i, t, "en", "src") for i, t in rows], "doc_id long, text string, lang string, source string")
        for name in more.get("extra", ()):
            df = df.withColumn(name, F.lit("x"))
        return df

    return build
