import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from risklib.session import checkpoint_root, get_spark
    s = get_spark("local[4]", app="risklib-tests", shuffle_partitions=4)
    checkpoint_root(s)
    yield s


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols[:1]).collect()]
