"""Hand-made fixtures with known answers."""

import datetime

import pytest

from orrery.operators.delta import patch_column, upsert
from orrery.operators.provenance import provenance, span
from orrery.operators.transfer import drop_weak


def test_provenance(spark):
    d = datetime.date.fromisoformat
    patents = spark.createDataFrame([(10, d("1995-01-01")), (11, d("2010-01-01")), (12, d("2020-01-01")), (20, d("2001-01-01"))], "record bigint, date date")
    links = spark.createDataFrame([(1, 10, True), (2, 20, True), (1, 11, False), (1, 12, False)], "item bigint, record bigint, claimed boolean")
    out = provenance(links, patents, 5).orderBy("item", "place").collect()
    assert [(r.item, r.n, r.record) for r in out] == [(1, 3, 10), (1, 3, 12), (1, 3, 11), (2, 1, 20)]
    assert out[0].claimed and not out[0].noise


def test_links_to_missing_records_count(spark):
    records = spark.createDataFrame([(1, None)], "record bigint, date date")
    links = spark.createDataFrame([(7, 1, False), (7, 99, False)], "item bigint, record bigint, claimed boolean")
    assert [(r.n, r.record, r.noise) for r in provenance(links, records, 5, noise=1).collect()] == [(2, 1, True)]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 8])
def test_span_is_never_longer(spark, k):
    rows = [(1, i, datetime.date(2000, 1, 1 + i)) for i in range(6)]
    out = [r.i for r in span(spark.createDataFrame(rows, "g int, i int, date date"), "g", "date", "i", k).collect()]
    want = set(range(6)[: (k + 1) // 2]) | set(range(6)[6 - k // 2 :] if k > 1 else [])
    assert set(out) == want and len(out) <= max(k, 0)


def test_denoise(spark):
    p = spark.createDataFrame([(0, "P1", 0.80, 5), (0, "P2", 0.35, 1), (0, "P3", 0.45, 1), (0, "P4", 0.30, 3)], "qid int, label string, conf double, support int")
    assert [r.label for r in drop_weak(p).orderBy("rk").collect()] == ["P1", "P3", "P4"]
    assert [r.label for r in drop_weak(p, most=2).orderBy("rk").collect()] == ["P1", "P3"] and p.count() == 4


def test_upsert_twice_is_once(spark):
    base, patch = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = upsert(base, patch, ["k"])
    assert sorted(once.collect()) == sorted(upsert(once, patch, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert {(r.k, r.v) for r in patch_column(base, spark.createDataFrame([(1, None)], "k int, v string"), "k", "v").collect()} == {(1, None), (2, "b")}
