"""Every registered query against its oracle on the smallest tables."""

import pytest

from heliofleet.checks import load_all
from heliofleet.checks.compare import compare

QUERIES, ORACLES = load_all()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, "/root/testdata/sf0.001", name)
    assert ok, note


def test_names_and_oracles():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 120
