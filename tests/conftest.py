import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    from biotally.session import local_session

    s = local_session(4)
    yield s
    s.stop()
