import tempfile

import pytest

from crowdsignal.session import release, session


@pytest.fixture(scope="session")
def spark():
    return session(4, 4, spark__local__dir=tempfile.mkdtemp(prefix="spark-"), spark__driver__memory="4g")


@pytest.fixture(autouse=True)
def cleared(spark):
    """Tables in the shared folder are deleted after each test."""
    yield
    release(spark)


@pytest.fixture
def rows():
    """Rows of a table as sorted tuples."""
    return lambda df: sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
