from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from priceengine.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-test-")
    session = (
        builder("tests", master=f"local[{os.environ.get('TEST_CPUS', '4')}]", shuffle_partitions=4)
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{scratch}/shared").config("spark.local.dir", f"{scratch}/local")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_sf() -> str:
    return "/root/testdata/sf0.001"
