import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vouchline.session import build_session

    session = build_session(
        "local[8]", 4, **{"spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
                          "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def all_hot(monkeypatch):
    """Treat every key with more than two rows as hot and use tiny blocks, so that small data takes the split path."""
    from vouchline import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    monkeypatch.setattr(skew, "BLOCK", 3)
