import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from spanforge.session import build

    s = build(master="local[4]", partitions=3)
    yield s
    s.stop()
