import pytest
from pyspark.sql import functions as F


@pytest.fixture
def make(spark):
    """A frame from rows and a schema; ``extra`` columns have names that operators use themselves."""
    def build(rows, schema, extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:
            for name in ("n", "fp", "score", "text_key0", "mixture0", "key", "segment", "rank", "copies", "shard", "languages"):
                if name not in df.columns:
                    df = df.withColumn(name, F.lit("x"))
        return df
    return build


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
