import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from tidewright.session import session, ship

    s = session("local[4]", partitions=4, memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
