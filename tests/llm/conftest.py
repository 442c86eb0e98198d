import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` rows, in three partitions."""

    def make(rows):
        full = [(*r, "en", "src0", len(r[1] or "")) if len(r) == 2 else (*r, len(r[1] or "")) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Nulls, empty and blank texts, ties, repeated rows and one long text.
ODD = [
    (None, "a b c"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two three four"), (4, "one two three four"),
    (5, "one two three four"), (4, "another text with this id"), (6, "x" * 5000), (7, "lorem ipsum dolor sit amet " * 3000),
]


@pytest.fixture(scope="session")
def odd(frame):
    """The odd rows with extra columns whose names operators may use themselves."""
    from pyspark.sql import functions as F

    names = ("key", "row", "h", "fp", "component_id", "n", "p_0", "distance", "slot", "_uid", "tokens", "n_removed")
    return frame(ODD).withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="session")
def none(frame):
    return frame([])
