import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from polyview.session import build, clean  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", partitions=4, memory="6g")
    yield session
    clean(session)
    session.stop()
