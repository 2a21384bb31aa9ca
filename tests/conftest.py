import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="cohortlens-test-ckpt-")
    s = get_spark("local[4]", app="cohortlens-tests", shuffle_partitions=4,
                  spark__checkpoint__dir=ckpt)
    s.sparkContext.setCheckpointDir(ckpt)
    yield s


def rows(df, order=None):
    """Collect a (small, test-sized) frame as sorted tuples."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t)) if order is None else out
