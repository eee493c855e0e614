import os

import pytest

from stratalog.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 3g pyspark-shell")
    session = build_session("tests", master="local[2]", shuffle_partitions=2)
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
