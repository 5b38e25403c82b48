import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from relops.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def schema(spark):
    from relops.workload.base import scratch_schema

    return scratch_schema(spark)
