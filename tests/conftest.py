import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from skyloom.session import session

    s = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def targets(spark):
    from skyloom.session import stage
    from workload.views import view

    return stage(view(spark, "/root/testdata/sf0.001", "targets"), "targets")[0]


@pytest.fixture(scope="session")
def pointings(spark):
    from skyloom.session import stage
    from workload.views import view

    return stage(view(spark, "/root/testdata/sf0.001", "pointings"), "pointings")[0]
