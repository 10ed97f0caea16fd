import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from edgetide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # coalescing is off so that small fixtures really spread over several partitions
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "5", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
