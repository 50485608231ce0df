import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sparvec.session import local_session, ship

    s = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
