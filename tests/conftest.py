import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dockledger.plans.versions import load_version, publish_version  # noqa: E402
from dockledger.sources.sample import sample_tables  # noqa: E402
from dockledger.tables import TABLE_NAMES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master(f"local[{os.cpu_count() or 4}]")
        .appName("dockledger-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """The smallest test data as stored tables, which is how they are used."""
    root = str(tmp_path_factory.mktemp("stored"))
    t = sample_tables(spark, SMALL)
    publish_version(spark, {name: t[name] for name in TABLE_NAMES}, root)
    return load_version(spark, root)
