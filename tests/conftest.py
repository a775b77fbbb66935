import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from querywright.session import session

    base = tmp_path_factory.mktemp("spark")
    made = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.local.dir": str(base / "local")})
    made.sparkContext.setLogLevel("ERROR")
    made.sparkContext.setCheckpointDir(str(base / "shared"))
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
