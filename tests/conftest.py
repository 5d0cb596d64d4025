import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tools.local_session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tiny inputs: interpreted, unadapted plans start faster than compiled ones.
    quick = {
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "3",
    }
    session = local_session("tests", "4", **quick)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
