import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from runlens.session import session

    # Tiny inputs: interpreted plans start faster than compiled ones; compare.py runs them compiled.
    s = session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.sql.codegen.wholeStage": "false", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
