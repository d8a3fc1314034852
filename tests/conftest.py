import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    session = local_session(4, 4, "6g")
    yield session
    session.stop()
