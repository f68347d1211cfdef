import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from cairnwise.llm.shipping import ship_package

    ship_package(spark)
