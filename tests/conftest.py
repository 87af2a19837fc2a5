import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paths import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from corpuskit.session import get_spark
    s = get_spark(cores=4, shuffle_partitions=4, app="corpuskit-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables_small(spark):
    from corpuskit.tables import Tables
    return Tables(spark, SF_SMALL)
