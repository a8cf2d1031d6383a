"""Top N, hot keys and snapshot changes against brute force and on awkward input."""

import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.operators.hotkeys import exact_quantiles, from_ordered_bits, ordered_bits, select_ranks
from orrery.operators.snapshots import snapshot_changes
from orrery.operators.topn import graded_bin, latest_rows, top_n_per_group

ORDER = lambda: [F.col("s").desc(), F.col("c").desc(), F.col("i")]


def ranked(df, n=3):
    cells = graded_bin([(F.col("s"), 0, 8, 8), (F.col("c"), 0.0, 1.0, 16)])
    return top_n_per_group(df, ["g"], ORDER(), n, cells, F.col("i"))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b", "c", None]), st.integers(0, 7), st.sampled_from([0.0, 0.25, 0.5, 1.0]), st.integers(0, 99)), max_size=60))
def test_top_n_equals_sorting(spark, rows):
    got = sorted((r.g, r["rank"], r.s, r.c, r.i) for r in ranked(spark.createDataFrame(rows, "g string, s int, c double, i bigint")).collect())
    by = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by[r[0]].append(r)
    want = sorted((g, k + 1, *r[1:]) for g, v in by.items() for k, r in enumerate(sorted(v, key=lambda r: (-r[1], -r[2], r[3]))[:3]))
    assert got == want


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([-9, -1, 0, 3, 7, 8, 9, 33, 44]), st.sampled_from([-2.0, 0.01, 0.5, 0.99, 1.0, 7.0]), st.integers(0, 99)), max_size=40))
def test_top_n_beyond_the_range_of_the_bins(spark, rows):
    got = [(r.s, r.c, r.i) for r in ranked(spark.createDataFrame([("a", *r) for r in rows], "g string, s int, c double, i bigint")).orderBy("rank").collect()]
    assert got == sorted(rows, key=lambda r: (-r[0], -r[1], r[2]))[:3]


def test_bins_never_rise_along_the_order(spark):
    rows = [(s, c) for s in (-1.5, 0.0, 0.3, 1.0, 1.7, 8.0, 8.5, 40.0, math.inf, math.nan) for c in (-1.0, 0.0, 0.4, 0.99, 1.0, 3.0, math.nan)]
    df = spark.createDataFrame(rows, "s double, c double")
    bins = [r.b for r in df.select("s", "c", graded_bin([(F.col("s"), 0, 8, 8), (F.col("c"), 0.0, 1.0, 16)]).alias("b")).orderBy(F.desc("s"), F.desc("c")).collect()]
    assert bins == sorted(bins, reverse=True) and len(set(bins)) > 5


def test_top_n_awkward(spark):
    schema = "g string, s int, c double, i bigint, bin string, rank int, Salt string"
    assert ranked(spark.createDataFrame([], schema)).count() == 0
    rows = [("a", 1, 0.5, 1, "x", 9, None), ("a", 1, 0.5, 1, "x", 9, None), ("a", None, 0.5, 2, None, 9, "y")]
    out = ranked(spark.createDataFrame(rows, schema)).orderBy("rank").collect()
    assert [(r["rank"], r.i, r.bin) for r in out] == [(1, 1, "x"), (2, 1, "x"), (3, 2, None)]


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d")], "k int, v int, x string")
    assert {(r.k, r.x) for r in latest_rows(df, ["k"], "v", ["x"]).collect()} == {(1, "c"), (2, "d")}


def quantiles(rows, probs):
    by = defaultdict(list)
    for k, v in rows:
        if k is not None and v is not None and v == v:
            by[k].append(v)
    return {k: (len(v), *[sorted(v)[max(1, math.ceil(p * len(v))) - 1] for p in probs]) for k, v in by.items()}


def test_exact_quantiles(spark):
    rows = [("hot", float((i * 37) % 101) / 7) for i in range(900)] + [("even", 2.5)] * 50 + [(f"k{i % 20}", float(i)) for i in range(100)] + [(None, 1.0), ("hot", None), ("hot", math.nan)]
    rows += [("ends", math.inf), ("ends", -math.inf), ("ends", -0.0), ("ends", 5e-324), ("ends", -1e308), ("infinite", math.inf)]
    probs = (0.0, 0.5, 0.9, 1.0)
    out = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", probs)
    assert {r.k: (r.n, r.q0, r.q1, r.q2, r.q3) for r in out.collect()} == quantiles(rows, probs)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "a", "b"]), st.floats(allow_nan=False)), min_size=1, max_size=60))
def test_quantiles_of_any_doubles(spark, rows):
    out = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", [0.3, 0.5])
    assert {r.k: (r.n, r.q0, r.q1) for r in out.collect()} == quantiles(rows, (0.3, 0.5))


def test_ordered_bits():
    v = np.array([-np.inf, -1e308, -1.5, -5e-324, 0.0, 5e-324, 1.0, np.inf])
    c = ordered_bits(v)
    assert (np.diff(c) > 0).all() and (from_ordered_bits(c) == v).all() and ordered_bits(np.array([-0.0])) == ordered_bits(np.array([0.0]))


def test_ranks_of_different_values(spark):
    rows = [("a", v) for v in (5, 5, 5, -7, 2**62, 0)] + [("b", 1)] * 9 + [(None, 3), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    ranks = F.array(F.lit(2), F.lit(4)).cast("array<bigint>")
    assert {tuple(r) for r in select_ranks(df, ["k"], "v", ranks, distinct=True).collect()} == {("a", 4, 2, 0), ("a", 4, 4, 2**62)}
    assert {tuple(r) for r in select_ranks(df, ["k"], "v", ranks).collect()} == {("a", 6, 2, 0), ("a", 6, 4, 5), ("b", 9, 2, 1), ("b", 9, 4, 1)}
    assert {tuple(r) for r in select_ranks(df, ["k"], "v", F.array(F.lit(7).cast("bigint")), least=7).collect()} == {("b", 9, 7, 1)}


def test_hot_keys_empty(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert exact_quantiles(none, "k", "v", [0.5]).count() == 0


SNAP = "rel string, k string, t string, a array<string>, s struct<x:string,y:string>, l array<struct<p:string,q:string>>, at int"


def changes(df, **kw):
    return {(r.k, r.rel, r.change_kind) for r in snapshot_changes(df, "k", "rel", "at", **kw).collect()}


def test_changes_kinds(spark):
    rows = [
        ("1", "same", "t", ["a", "b"], ("x", None), [("p", "q")], 1), ("2", "same", "t", ["b", "a", "a"], ("x", None), [("p", "q"), ("p", "q")], 9),
        ("1", "null list", "t", None, None, None, 1), ("2", "null list", "t", [], None, [], 1),
        ("1", "null text", None, [], None, None, 1), ("2", "null text", "", [], None, None, 1),
        ("1", "moved null", "t", [], ("x", None), None, 1), ("2", "moved null", "t", [], (None, "x"), None, 1),
        ("1", "null member", "t", ["a"], None, None, 1), ("2", "null member", "t", ["a", None], None, None, 1),
        ("1", "struct", "t", [], None, None, 1), ("2", "struct", "t", [], (None, None), None, 1),
        ("1", "gone", "t", [], None, None, 1), ("2", "new", "t", [], None, None, 1),
        ("1", "late", "old", [], None, None, 1), ("1", "late", "new", [], None, None, 5), ("2", "late", "new", [], None, None, 1),
        ("1", None, "t", [], None, None, 1), (None, "x", "t", [], None, None, 1),
    ]
    df = spark.createDataFrame(rows, SNAP)
    want = {("null text", "2", "changed"), ("moved null", "2", "changed"), ("null member", "2", "changed"), ("struct", "2", "changed"), ("gone", "2", "removed"), ("new", "2", "added")}
    for size in (1, 4, 1000):
        assert changes(df, chunk_keys=size) == want
    assert changes(df.limit(0)) == set() and changes(df.filter("rel = '1'")) == set()


def test_chunk_of_one_old_release(spark):
    rows = [("1", "k0", "0", 0), ("2", "k1", "0", 1)]
    assert changes(spark.createDataFrame(rows, "rel string, k string, t string, at int"), chunk_keys=1) == {("k0", "2", "removed"), ("k1", "2", "added")}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["1", "2", "3"]), st.integers(0, 300), st.integers(0, 3)), max_size=400), st.sampled_from([1, 8]), st.sampled_from([3, 4096]))
def test_changes_equal_brute_force(spark, rows, size, most):
    last = {}
    rows = [(r, f"k{k:04d}", str(v), i) for i, (r, k, v) in enumerate(rows)]
    for r, k, v, _i in rows:
        last[r, k] = v
    rel = sorted({r for r, _k in last})
    want = set()
    for a, b in zip(rel, rel[1:]):
        for k in {k for r, k in last if r in (a, b)}:
            x, y = last.get((a, k)), last.get((b, k))
            if x != y:
                want.add((k, b, "added" if x is None else "removed" if y is None else "changed"))
    assert changes(spark.createDataFrame(rows, "rel string, k string, t string, at int"), chunk_keys=size, most_keys=most) == want
