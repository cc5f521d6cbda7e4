import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from tracemill.session import local_session, ship_package  # noqa: E402

SF = os.environ.get("TRACEMILL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, "tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    ship_package(s)
    yield s
    s.stop()
