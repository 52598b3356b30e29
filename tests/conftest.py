import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomline.session import session

    s = session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
