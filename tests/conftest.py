import pytest

from gitloom.session import local_session, release


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "gitloom-tests")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    release(session)
    session.stop()
