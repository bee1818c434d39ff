import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} of{i}" for i in range(30_000))

# Extra columns named like the operators' own.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("row", "key", "node", "n", "h", "token", "component", "kept", "value", "pos", "s", "f", "chunk", "score", "a", "b", "d", "t", "id")],
])


def doc(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * (len(SCHEMA) - 5))


PROSE = "one two three four five six seven eight nine ten eleven twelve. "

ODD = [
    doc(None, None, None, None),
    doc(None, PROSE * 6),
    doc(2, None),
    doc(3, ""),
    doc(4, " \t\n "),
    doc(5, PROSE * 3 + "the end of this one is here"),
    doc(5, PROSE * 3 + "the end of this one is here"),
    doc(7, "a"),
    doc(2**60 + 1, PROSE * 3 + "the end of this one is here"),
    doc(9, LONG, None),
    doc(10, "1234 5678\n\n!!\n😀 é́ \x00 ok"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
