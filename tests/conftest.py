import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tillroll.session import build_session
    s = build_session("local[4]", app="tillroll-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g"})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, *cols):
    """Rows as tuples, sorted with NULLs first (comparable across types)."""
    key = lambda t: tuple((v is not None, str(v)) for v in t)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
