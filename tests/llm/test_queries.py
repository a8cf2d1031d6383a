import pytest

from orrery.llm import queries
from orrery.session import table
from tests.compare import same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, data, name):
    same(spark, data, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_shares(spark):
    """On 10 000 documents the shares reached are those that the sources with documents can have."""
    rows = queries.p8_shares(spark, "/root/testdata/sf0.1").collect()
    assert abs(sum(r.actual_share for r in rows) - 1) < 1e-9
    for r in rows:
        assert r.reachable_share is None and r.tokens == 0 or abs(r.actual_share - r.reachable_share) < 0.01


def test_budget(spark):
    rows = queries.p8_budget(spark, "/root/testdata/sf0.01", 60_000).collect()
    spent = sum(r.n_tokens for r in rows)
    assert 59_000 < spent <= 60_000 and [r.finish for r in rows] == sorted(r.finish for r in rows)


def test_pieces_hold_the_limit(spark, data):
    sizes = {r.table_name: r.m for r in queries.p2_pieces(spark, data).selectExpr("table_name", "length(text) as n").groupBy("table_name").agg({"n": "max"}).withColumnRenamed("max(n)", "m").collect()}
    assert sizes["trials"] <= 500 and sizes["patents"] <= 1000


def test_leaks_equal_brute_force(spark, data):
    from orrery.llm.leaks import words_of

    runs = {}
    for r in table(spark, data, "eval_items").collect():
        w = words_of(r.passage)
        for i in range(len(w) - 11):
            runs.setdefault(tuple(w[i : i + 12]), set()).add(r.item_id)
    want = set()
    for r in table(spark, data, "documents").filter("text is not null").collect():
        w = words_of(r.text)
        want |= {(r.doc_id, i) for k in range(len(w) - 11) for i in runs.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in queries.p7_found(spark, data).collect()} == want
