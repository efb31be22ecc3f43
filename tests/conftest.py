import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from assayframe.session import get_spark  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                  spark__driver__memory="8g", spark__cleaner__referenceTracking__cleanCheckpoints="true")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
