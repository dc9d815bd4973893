import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pairwright.session import build_session

    s = build_session("local[4]", app="pairwright-tests", shuffle_partitions=8)
    # Tests run on one machine: set a checkpoint folder only where none is set.
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairwright-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def pairs(spark):
    from pairwright.sources.fixture import load_fixture_pairs

    return load_fixture_pairs(spark, SF_SMALL).cache()


@pytest.fixture()
def tmp_dir(spark):
    from pairwright.session import scratch_path

    return scratch_path(spark, "test")


def plan_text(df) -> str:
    """Physical plan as planned (before adaptive re-planning adds a second copy)."""
    return df._jdf.queryExecution().sparkPlan().toString()
