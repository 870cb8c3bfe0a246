import pytest

from twintrail.llm.common import reachable


@pytest.fixture(scope="session")
def session(spark):
    return reachable(spark)


@pytest.fixture
def table(session, tmp_path):
    """Rows as a stored table, which operators that number rows need."""

    def make(rows, schema):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        session.createDataFrame(rows, schema).write.parquet(path)
        return session.read.parquet(path)

    return make
