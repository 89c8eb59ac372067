import pytest
from pyspark.sql import functions as F


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, a repeated id, and columns named like the operators' own."""
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (None, "x\ny"), (3, ""), (4, "long " * 40000), (5, None), (None, None), (6, " \n\n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_doc", "_rest", "_lines", "_kept", "_drop", "row", "found", "key", "fp", "least", "node", "root", "contamination", "toxicity", "ids", "media", "pages", "error", "width", "licenses", "host", "n_chars", "spans"):
        df = df.withColumn(name, F.lit(7).cast("long"))
    return df.withColumn("source", F.when(F.col("doc_id") > 1, "s"))


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
