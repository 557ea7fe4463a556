from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_rows import ROWS, documents  # noqa: E402

from sentika.llm.common import ship  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    ship(spark)
    return documents(spark, ROWS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    ship(spark)
    return documents(spark, ROWS).limit(0)
