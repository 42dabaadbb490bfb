import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pathmill.session import local_session

    session = local_session(4, 4, **{"spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()
