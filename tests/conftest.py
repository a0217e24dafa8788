import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from check import session

    from logloom.session import configure, drop_scratch

    started = configure(session())
    started.conf.set("spark.sql.shuffle.partitions", "4")
    yield started
    drop_scratch(started)
    started.stop()
