import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from touchline.session import build_session

    s = build_session("local[*]", 8, app_name="touchline-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def md(spark):
    from touchline.plans import catalog

    catalog.load_all()
    return catalog.data_for(spark, SMALL)
