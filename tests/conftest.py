import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "quire-tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-test-"),
           "spark.sql.streaming.checkpointLocation": tempfile.mkdtemp(prefix="spark-test-")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
