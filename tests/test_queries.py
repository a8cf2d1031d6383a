import pytest

import __spark_entry__ as entry
from orrery.plans import exchange, library, problems, records, serving
from tests.compare import same

ALL = library.QUERIES | records.QUERIES | exchange.QUERIES | serving.QUERIES | problems.QUERIES
SQL = library.SQL | records.SQL | exchange.SQL | serving.SQL | problems.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    same(spark, data, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, data, name):
    assert ALL[name](spark, data).count() > 0


def test_entry(spark, data):
    assert set(ALL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["acc", "pid"]


def test_group_split_fills_greedily(spark, data):
    rows = sorted(ALL["group_split"](spark, data).collect(), key=lambda r: (-r.n, r.grp))
    limit, used = 0.8 * sum(r.n for r in rows), 0
    for r in rows:
        fits = used + r.n <= limit
        assert r.in_train == fits
        used += r.n * fits
