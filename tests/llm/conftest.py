import os
import sys

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__))]

import pytest


@pytest.fixture(scope="session", autouse=True)
def pseudonym_key(spark):
    from segmill.llm import pii

    spark.conf.set(pii.SETTING, "a key for tests")
