import os

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def tables():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")


def rows(df):
    return [tuple(r) for r in df.collect()]
