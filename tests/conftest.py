import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from notewell.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = get_session(
        "local[4]", 4, **{"spark.ui.enabled": "false", "spark.checkpoint.dir": str(folder), "spark.sql.warehouse.dir": str(folder / "warehouse"),
                          "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
