import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import make, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, odd_rows())


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, odd_rows()).where("false")
