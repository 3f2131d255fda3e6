import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, or from (doc_id, text) pairs."""

    def make(texts, parts=3):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, DOCS).repartition(parts) if rows else spark.createDataFrame([], DOCS)

    return make


ODD = ["", None, " \n\t ", "a", "…", "x" * 70_000, "word " * 30_000, "tie one two three", "tie one two three", "naïve café ½ 😀\u0000 end", "'s't <|endoftext|> ### 12 34"]


@pytest.fixture
def odd_docs(docs_of):
    """Nulls, empty and long texts, repeated rows and ids, null ids, and extra columns with names that operators use."""
    from pyspark.sql import functions as F

    rows = [*enumerate(ODD), (None, "a null id"), (None, None), (3, "a"), (3, "another text")]
    df = docs_of(rows)
    for c in ("id", "t", "fp", "score", "component_id", "_kept", "_fp", "pii_found", "mix_tokens", "tokens", "ids", "x", "page"):
        df = df.withColumn(c, F.lit(1))
    return df
