import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or longer rows."""

    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return build


def rows_of(df):
    return [tuple(r) for r in df.collect()]
