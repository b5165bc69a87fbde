import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tallypact.session import local_session

    session = local_session("tests", cores="4", shuffle_partitions=4, driver_memory="4g")
    yield session
    session.stop()
