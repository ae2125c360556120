import pytest

from quietgate.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    })
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    def make(*values):
        return spark.createDataFrame(list(enumerate(values)), "id bigint, text string")
    return make


def column(df, name):
    """Values of one column in id order."""
    return [r[0] for r in df.orderBy("id").select(name).collect()]
