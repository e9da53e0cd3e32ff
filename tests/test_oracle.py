"""Every named analysis against its SQL on the smallest tables."""

import os

import pytest
from compare import differences, duck

from claimweave.plans import ANALYSES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(ANALYSES))
def test_analysis(spark, con, name):
    analysis = ANALYSES[name]
    result = analysis.run(spark, FOLDER)
    if analysis.sql is None:
        assert result.count() >= 0
    else:
        assert differences(result, analysis.sql, con) == []
