import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskgraph.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g",
        "spark.default.parallelism": "2"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
