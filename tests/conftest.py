import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vicinity.plans.session import local_session
    from vicinity.session import ship_package

    session = local_session(memory="4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """``table(ddl, *rows)``."""

    def make(ddl, *rows):
        return spark.createDataFrame(list(rows), ddl)

    return make
