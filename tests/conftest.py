import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from quillstone.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "4"), spark__sql__adaptive__coalescePartitions__enabled="true")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
