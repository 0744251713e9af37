import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spendlens.session import local_session

    s = local_session("4", shuffle_partitions=4, app="spendlens-tests")
    yield s
    s.stop()
