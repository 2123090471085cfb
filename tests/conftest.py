import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("quern-tests").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frozen(x):
    """Documents as hashable values, so that sets can be compared."""
    if isinstance(x, dict):
        return frozenset((k, frozen(v)) for k, v in x.items())
    if isinstance(x, (list, set, frozenset)):
        return frozenset(map(frozen, x))
    return x


@pytest.fixture(scope="session")
def same():
    def check(found, expected):
        assert frozen(found) == frozen(expected), found

    return check
