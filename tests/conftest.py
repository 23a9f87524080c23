from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import deskmill  # noqa: E402
from deskmill.session import get_spark  # noqa: E402

cloudpickle.register_pickle_by_value(deskmill)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        app="tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def at(hour: int, minute: int = 0, day: int = 1, second: int = 0) -> datetime:
    return datetime(2024, 3, day, hour, minute, second)
