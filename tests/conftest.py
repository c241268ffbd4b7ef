import pytest

from symweave.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("OFF")
    yield s


@pytest.fixture
def df(spark):
    """``df(rows, schema)`` as a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
