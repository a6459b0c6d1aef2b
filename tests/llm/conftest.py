import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def sf001(spark):
    """The smallest documents with awkward rows added: null and empty texts, a
    null id, null source, a repeated row, a very long text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long_text = " ".join(f"word{i % 977} filler{i % 31}." for i in range(60_000))
    extra = spark.createDataFrame([
        (10_001, None, "en", "src1", 0), (10_002, "", "en", None, 0), (10_003, "   \n\t ", None, None, 6),
        (None, "one lonely text with a null id", "en", "src2", 30), (10_004, "the same row twice", "en", "src2", 18),
        (10_004, "the same row twice", "en", "src2", 18), (10_005, long_text, "en", "src3", len(long_text)),
        (10_006, long_text, "de", "src4", len(long_text)), (10_007, "ÀÉ \U0001f600 emoji", "fr", "src3", 10)], DOCS)
    path = "/root/testdata/sf0.001"
    return docs.select(*[F.col(c) for c in DOCS.names]).unionByName(extra).cache(), path


@pytest.fixture(scope="session")
def rows(sf001):
    return [(r["doc_id"], r["text"], r["source"]) for r in sf001[0].collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns named like results and internals of the operators."""
    names = ["_t", "_id", "k", "f", "h", "size", "_size", "_copies", "score", "kept", "component_id", "n", "id", "x", "_gone", "_salt", "c", "key"]
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s1", 13), (2, "a b c d e f g", "en", "s2", 13), (3, "other words entirely here now", "en", None, 5)], DOCS)
    return docs.withColumns({n: F.lit("clash") for n in names})
