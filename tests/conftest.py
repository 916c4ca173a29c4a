import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hindcast.functions.scale import remove_scratch  # noqa: E402
from hindcast.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("local[8]", 8, **{"spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    remove_scratch(spark)
    spark.stop()
