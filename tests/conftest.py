import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quernstone.session import local_session

    session = local_session(4, memory="4g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
