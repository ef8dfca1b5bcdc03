import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for p in (HERE, os.path.dirname(HERE)):
    if p not in sys.path:
        sys.path.insert(0, p)


@pytest.fixture(scope="session")
def spark():
    from sheetlens.session import local_session

    s = local_session("*", shuffle_partitions=8, app="sheetlens-tests")
    yield s
    s.stop()
