import os

import pytest

import compare
from lanewise.plans import catalog, oracle

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_every_report_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.REPORTS))
def test_report_matches_sql(spark, duck, name):
    """Equal rows, and some of them."""
    report = catalog.queries()[name](spark, FOLDER)
    assert compare.differences(report, duck, oracle.oracle_sql()[name], some=True) == []
