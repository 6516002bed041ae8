import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vestige.session import session, ship

    shared = tmp_path_factory.mktemp("shared")
    out = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(shared), "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    out.sparkContext.setLogLevel("ERROR")
    ship(out)
    yield out
    out.stop()
