import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check_oracles import session  # noqa: E402
from tesserae.workspace import clear  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session(8)
    yield found
    clear(found)
