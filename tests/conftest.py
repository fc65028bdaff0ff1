import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from runlens.session import importable, local_session

    spark = local_session(cores="4", partitions=4, memory="4g")
    importable(spark)
    yield spark
    spark.stop()
