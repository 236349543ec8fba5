import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session", autouse=True)
def scratch(spark):
    """Scratch tables go when the tests are done."""
    yield
    from larder.llm.common import drop_scratch

    drop_scratch(spark)
