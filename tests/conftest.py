import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalens.session import clear_stages, local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions="4", driver_memory="6g")
    yield session
    clear_stages(session)


@pytest.fixture(scope="session")
def folder():
    if not Path(DATA).exists():
        pytest.skip("test tables not present")
    return DATA
