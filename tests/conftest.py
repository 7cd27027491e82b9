import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from longdoc.session import get_spark, shared_dir
    s = get_spark("local[4]", shuffle_partitions=8, app="longdoc-tests")
    shared_dir(s)
    yield s
    s.stop()
