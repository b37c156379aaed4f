import pytest

from newsloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    yield session
    session.stop()
