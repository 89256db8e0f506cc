import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from chainsight.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4, app_name="chainsight-tests")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
