import pytest

from ward_analytics.llm import tables


@pytest.fixture(scope="session")
def workers(spark):
    """The session, with workers that can import the package."""
    tables.ship(spark)
    return spark


@pytest.fixture
def frame(workers):
    """Documents with extra columns whose names the operators use themselves."""

    def make(rows):
        df = workers.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, chunk string, n_words int, score double")
        return df.repartition(3)

    return make
