import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    from namemine.sources.tables import read_table

    return read_table(spark, SMALL, "documents")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.fixture
def odd(spark):
    """Documents with a null id, null and empty texts, repeated rows and columns whose names clash
    with what operators add."""
    def make(texts):
        rows = [(i, t, f"x{i}", 1.5, "w") for i, t in texts]
        return spark.createDataFrame(rows, "doc_id long, text string, fp string, log_weight double, words string")

    return make
