import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flowtide.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=8, extra={"spark.flowtide.store": f"file://{tmp_path_factory.mktemp('store')}"})
    yield s
    s.stop()
