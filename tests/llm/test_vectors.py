import numpy as np
import pytest

from orrery.llm.mixing import mix_sources, virtual_horizon
from orrery.llm.vectors import Lists, Rotation, _unit, encode, estimate, nearest_fingerprints


def crowd(seed, n, scaffolds=12):
    """Fingerprints around a few scaffolds, a third of them around the first, some alone."""
    rng = np.random.default_rng(seed)
    base = np.random.default_rng(1).random((scaffolds, 2048)) < 0.025
    out = []
    for i in range(n):
        b = rng.random(2048) < 0.025 if i % 5 == 4 else base[0 if i % 3 == 0 else rng.integers(scaffolds)].copy()
        out.append(np.where(rng.random(2048) < 0.3, False, b) | (rng.random(2048) < 0.004))
    return np.packbits(np.array(out), axis=1, bitorder="little").view(np.int64)


def brute(q, r, k=10, floor=0.5):
    out = set()
    for i, a in enumerate(q):
        both = np.bitwise_count((a & r).view(np.uint64)).sum(1)
        either = np.bitwise_count((a | r).view(np.uint64)).sum(1)
        s = both / np.maximum(either, 1)
        out |= {(i, int(j)) for j in sorted(np.flatnonzero(s >= floor), key=lambda j: (-s[j], j))[:k]}
    return out


@pytest.mark.parametrize("block", [4096, 64])
def test_recall(spark, block):
    q, r = crowd(2, 400), crowd(3, 900)
    want = brute(q, r)
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "id bigint, fp array<bigint>")
    rs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r)], "cid bigint, fp array<bigint>")
    got = {(x.id, x.cid) for x in nearest_fingerprints(qs, rs, block=block).collect()}
    assert len(want) > 1000 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_lists_of_pairs(spark):
    """More lists than centres: each is a pair of centres, and the recall stays."""
    q, r = crowd(2, 400), crowd(3, 1500)
    want = brute(q, r)
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "id bigint, fp array<bigint>")
    rs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r)], "cid bigint, fp array<bigint>")
    got = {(x.id, x.cid) for x in nearest_fingerprints(qs, rs, max_lists=12, per_list=30, block=256).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    x = _unit(r)
    lists = Lists(r[:192], Rotation(2048), 50, 12, 256)
    row, at = lists.near(x, 0.1)
    assert (lists.first, lists.second) == (12, 5) and set(zip(range(len(x)), lists.own(x).tolist())) <= set(zip(row.tolist(), at.tolist()))


def test_bounds_hold():
    words = crowd(4, 300)
    rotation = Rotation(2048)
    x = _unit(words)
    codes, norm, own = encode(rotation(x, 1024))
    cosine, bound = estimate(rotation(x[:50], 1024), codes, norm, own, 2048, 3.0)
    off = np.abs(cosine - x[:50] @ x.T) > bound
    off[np.arange(50), np.arange(50)] = False
    assert off.mean() < 0.01


def test_awkward(spark):
    a, b = crowd(5, 2).tolist()
    schema = "id bigint, fp array<bigint>, list int"
    rows = [(1, a, 0), (1, a, 0), (2, None, 0), (3, [0] * 32, 0), (4, a[:5], 0), (5, [None] + a[1:], 0), (None, a, 0), (6, b, 0)]
    q = spark.createDataFrame(rows, schema)
    r = spark.createDataFrame([(9, a), (8, a), (8, a), (7, None), (6, [0] * 32)], "cid bigint, fp array<bigint>")
    out = sorted(tuple(x) for x in nearest_fingerprints(q, r, k=2, floor=0.99).collect())
    assert out == [(1, 8, 1.0), (1, 9, 1.0)]
    assert nearest_fingerprints(q.limit(0), r).count() == 0 and nearest_fingerprints(q, r.limit(0)).count() == 0


def test_horizon():
    assert virtual_horizon([], None) == 0
    assert virtual_horizon([(0.5, 100, 50), (0.5, 400, 400)], None) == 200
    assert virtual_horizon([(0.5, 100, 50), (0.5, 400, 400)], 300) == pytest.approx(400)
    assert virtual_horizon([(1.0, 100, 100)], 1000) == float("inf")


def test_mixture(spark):
    docs = [(i, "word " * (1 + i % 7), "A " if i % 2 else " a") for i in range(300)] + [(1000 + i, "word " * 5, "b") for i in range(20)] + [(2000, "word", "zz"), (2001, None, "a"), (2002, "", "b"), (None, "word", "a"), (1000, "word " * 5, "b"), (2003, "x", None)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, source string, tokens int")
    s = spark.createDataFrame([("A", 0.6, 1), ("b", 0.3, 3), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(d, s)
    rows, by = mixture.collect(), {r.source: r for r in report.collect()}
    assert by["none"].tokens == 0 and abs(by["a"].actual_share - 2 / 3) < 0.02 and abs(by["b"].actual_share - 1 / 3) < 0.02
    assert max(r.copy_no for r in rows if r.source == "a") == 1 and max(r.copy_no for r in rows if r.source == "b") <= 3
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows) and sum(r.n_tokens for r in rows) == sum(r.tokens for r in by.values())
    finish = [r.finish for r in rows]
    assert finish == sorted(finish)
    some = mix_sources(d, s, budget=200)[0].collect()
    assert 190 <= sum(r.n_tokens for r in some) <= 200
    every = mix_sources(d, s, budget=10**9)[0].collect()
    assert len(every) == 300 + 60
    assert mix_sources(d.limit(0), s)[0].count() == 0
