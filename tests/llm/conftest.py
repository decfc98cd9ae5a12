import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of given texts, with ids from 0, or of (id, text) pairs."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)

    return make


#: Cases that every operator must take: null, empty, blanks, one word, ties, repeated rows, odd scripts, long.
ODD = [None, "", " \t\n", "word", "word", "Same text here\nand there", "Same text here\nand there", "naïve ÇA İΣ 中文 ½ é <|endoftext|> it's", "x" * 30_000, "one two three four five six\n" * 3000]


@pytest.fixture
def odd_docs(docs_of):
    """Odd texts, a repeated row, a null id, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    df = docs_of([*enumerate(ODD), (3, "word"), (None, "no id")])
    for name in ("row_key", "digest", "run", "bucket", "piece", "key", "h1", "keep_bitmap_", "score", "kept", "length", "item_id", "_h"):
        df = df.withColumn(name, F.lit("clash"))
    return df
