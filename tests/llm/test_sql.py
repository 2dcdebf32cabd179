"""The operators that SQL can express against DuckDB, at the smallest scale."""

import os

import pytest

from pagewright.llm import queries
from tests.test_queries import SF, duck, rows  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):  # noqa: F811
    found = queries.QUERIES[name](spark, SF)
    expected = duck.sql(queries.ORACLES[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())


def test_quality_keeps_what_is_labelled_good(spark):
    """No document labelled good is rejected for anything but the base rules."""
    out = queries.op1_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert out.where("quality = 1 and not base_failed and not kept").count() == 0
    assert out.where("quality = 0 and kept").count() <= 0.1 * out.where("quality = 0").count()
