import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("tabsight-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from tabsight.session import checkpoint_root
    checkpoint_root(s)   # the session's shared folder, or a fresh local one when unset
    yield s
    s.stop()


@pytest.fixture
def csv_file(tmp_path):
    def make(text: str, name: str = "t.csv") -> str:
        p = tmp_path / name
        p.write_bytes(text.encode("utf-8") if isinstance(text, str) else text)
        return str(p)
    return make
