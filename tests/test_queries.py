"""Each registered query of the report engine against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from pagewright.plans import catalogue, word  # noqa: F401  (registers its queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data]
    return sorted(columns), sorted(plain, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    expected = duck.sql(catalogue.ORACLES[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())


def test_all_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["doc_id", "section", "seq", "col_no", "text"] and out.count() > 0


def test_pages_are_filtered_below_the_window(spark):
    r = catalogue.Report(spark, SF)
    from pagewright.operators import select

    plan = select.filter_pages(select.with_timeline(r.rows), ["2-HIGH"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.rindex("2-HIGH"), plan
