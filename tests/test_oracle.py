"""Every registered query against its SQL oracle on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from ledgerlake.plans import registry
from oracle_check import compare

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    assert compare(spark, SF, name) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_only_these_have_no_oracle():
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"embed_text"}
