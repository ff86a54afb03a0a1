import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from oracle import session
    s = session()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from civicledger.plans.bindings import Tables
    return Tables(spark, SF)
