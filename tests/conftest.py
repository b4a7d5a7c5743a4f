import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tableflow.session import build_session  # noqa: E402

TESTDATA = os.environ.get("TABLEFLOW_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        4,
        **{
            "spark__checkpoint__dir": str(tmp_path_factory.mktemp("work")),
            "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark__sql__shuffle__partitions": "2",
            "spark__default__parallelism": "2",
            "spark__sql__maxMetadataStringLength": "2000",  # a plan names its folders whole, however long the path
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def medium():
    return f"{TESTDATA}/sf0.01"
