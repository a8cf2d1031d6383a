"""Queries over crowded tables: what lies beyond the nearest rows counts too. Small blocks against brute force."""

import numpy as np

import pytest

from orrery.operators import simjoin
from orrery.plans.library import QUERIES


def fingerprint(bits):
    words = np.zeros(32, np.uint64)
    for b in bits:
        words[b // 64] |= np.uint64(1) << np.uint64(b % 64)
    return [int(w) for w in words.view(np.int64)]


def crowd(n, seed=3):
    """Sets of bits around one scaffold, and their fingerprints."""
    r = np.random.default_rng(seed)
    sets = [frozenset(range(12)) | frozenset(map(int, r.choice(np.arange(12, 60), r.integers(0, 30), replace=False))) for _ in range(n)]
    return sets, [fingerprint(s) for s in sets]


def tanimoto(a, b):
    return round(len(a & b) / len(a | b), 12)


def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def compounds(spark, folder):
    """Three queries and 260 ligands that are all near them: (folder, sets of the queries, sets of the ligands)."""
    sets, fps = crowd(263)
    asked = {50 * (i + 1): s for i, s in enumerate(sets[:3])}
    d = put(
        spark,
        folder,
        patent_compounds=([(k, f, "C") for k, f in zip(asked, fps[:3])] + [(7, fps[0], "C")], "id bigint, fp array<bigint>, smiles string"),
        chembl=([(i, f, "C") for i, f in enumerate(fps[3:])], "cid bigint, fp array<bigint>, smiles string"),
        targets=([(f"P{i}",) for i in range(9)], "acc string"),
    )
    return d, asked, dict(enumerate(sets[3:]))


def test_density_counts_every_neighbour(spark, tmp_path):
    d, asked, refs = compounds(spark, tmp_path)
    want = {q: tuple(sum(tanimoto(a, b) >= t for b in refs.values()) for t in (0.7, 0.5, 0.4, 0.3)) for q, a in asked.items()}
    assert max(n[3] for n in want.values()) > 100
    assert {r.qid: (r.n_70, r.n_50, r.n_40, r.n_30) for r in QUERIES["density_thresholds"](spark, d).collect()} == want


def test_counts_of_blocks_add_up(spark):
    sets, fps = crowd(70)
    t = spark.createDataFrame(list(enumerate(fps)), "id bigint, v array<bigint>")
    found = simjoin.count_within(t, t, {"n": 0.5}, block=16).collect()
    assert {r.qid: r.n for r in found} == {i: sum(tanimoto(a, b) >= 0.5 for b in sets) for i, a in enumerate(sets)}


def test_sea_sums_all_ligands_against_all_pairs(spark, tmp_path):
    d, asked, refs = compounds(spark, tmp_path)
    sim = {(q, r): s if (s := tanimoto(a, b)) >= 0.4 else 0.0 for q, a in asked.items() for r, b in refs.items()}
    m, s2 = np.mean(list(sim.values())), np.mean(np.square(list(sim.values())))
    own = {f"P{i}": [r for r in refs if i in (r % 9, (r * 7 + 3) % 9)] for i in range(9)}
    want = {}
    for q in asked:
        for label, ids in own.items():
            if any(sim[q, r] for r in ids):
                want[q, label] = (sum(sim[q, r] for r in ids) - len(ids) * m) / np.sqrt(len(ids) * (s2 - m * m))
    assert max(sum(sim[q, r] > 0 for r in refs) for q in asked) > 100
    got = {(r.qid, r.label): r.z for r in QUERIES["sea_zscore"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_label_sums_of_blocks_add_up(spark):
    sets, fps = crowd(70)
    own = {i: [f"L{i % 4}"] * (i % 3 > 0) + ["all"] * (i % 5 == 0) for i in range(70)}
    t = spark.createDataFrame([(i, f, own[i] or None) for i, f in enumerate(fps)], "id bigint, v array<bigint>, labels array<string>")
    got = {(r.qid, r.label): (round(r.raw, 9), r.n) for r in simjoin.label_sums(t.select("id", "v"), t, 0.5, block=16).collect()}
    want = {}
    for i, a in enumerate(sets):
        near = {j: tanimoto(a, b) for j, b in enumerate(sets) if tanimoto(a, b) >= 0.5}
        want[i, None] = (round(sum(near.values()), 9), 70)
        for label in {x for j in near for x in own[j]}:
            mine = [s for j, s in near.items() if label in own[j]]
            want[i, label] = (round(sum(mine), 9), len(mine))
    assert got == want


def cosines(vectors):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.round(u @ u.T, 6)


def embeddings(spark, folder, n=220, labels=5):
    """Random vectors, those of the last label opposite to all others."""
    v = np.random.default_rng(5).normal(size=(n, 8)).astype(np.float32)
    label = [(i * 3 + 1) % labels for i in range(n)]
    v[:, 0] = np.where(np.array(label) == labels - 1, -9, 9)
    d = put(spark, folder, embeddings=([(i, [float(x) for x in v[i]], label[i]) for i in range(n)], "vec_id bigint, embedding array<float>, label int"))
    return d, cosines(v.astype(float)), label


def test_debiased_rank_ranks_all_rows(spark, tmp_path):
    d, s, _ = embeddings(spark, tmp_path)
    asked = list(range(0, len(s), 50))
    bias = [np.mean([s[q, r] for q in asked if q != r]) for r in range(len(s))]
    want = {(q, r, k + 1) for q in asked for k, r in enumerate(sorted((r for r in range(len(s)) if r != q), key=lambda r: (-round(s[q, r] - bias[r], 6), r))[:3])}
    assert any(r % 50 for _, r, _ in want)
    assert {(r.qid, r.rid, r.rk) for r in QUERIES["debiased_rank"](spark, d).collect()} == want


def test_bias_in_blocks(spark):
    v = np.random.default_rng(6).normal(size=(70, 8))
    s = cosines(v)
    t = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(70)], "id bigint, v array<double>")
    got = {r.rid: r["mean"] for r in simjoin.mean_similarity(t.filter("id % 2 = 0"), t, "cosine", 6, block=16).collect()}
    assert got.keys() == set(range(70)) and all(abs(got[r] - np.mean([s[q, r] for q in range(0, 70, 2) if q != r])) < 1e-9 for r in got)


@pytest.mark.parametrize("name", ["loo_recall_at_k", "scaffold_holdout_recall"])
def test_guards_hold_before_the_nearest_are_taken(spark, tmp_path, name):
    """The query has 230 copies of its own scaffold, and one voter farther off, which shares a label with it."""
    near, voter = frozenset(range(20)), frozenset(range(10))
    rows = [(50, near, "CCCCCCN")] + [(1000 * i + 1, near, "CCCCCCO") for i in range(1, 231)] + [(59, voter, "NNNNNNO")]
    d = put(spark, tmp_path, chembl=([(i, fingerprint(b), x) for i, b, x in rows if i == 50 or i % 50], "cid bigint, fp array<bigint>, smiles string"), targets=([(f"P{i}",) for i in range(9)], "acc string"))
    r = QUERIES[name](spark, d).first()
    assert (r.n_queries, r.recall_5) == (1, 1.0)


def test_guards_in_blocks(spark):
    sets, fps = crowd(70)
    group = [None if i % 7 == 0 else f"G{i % 3}" for i in range(70)]
    t = spark.createDataFrame([(i, f, group[i]) for i, f in enumerate(fps)], "id bigint, v array<bigint>, g string")
    got = {(r.qid, r.rid, r.rk) for r in simjoin.nearest(t, t, 5, 0.3, block=16, others=True, below=0.7, apart="g").collect()}
    want = set()
    for i, a in enumerate(sets):
        ok = sorted((-s, j) for j, b in enumerate(sets) if j != i and group[i] != group[j] and 0.3 <= (s := tanimoto(a, b)) < 0.7)
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(ok[:5])}
    assert got == want


def ranks(s, asked, label):
    want = {}
    for q in asked:
        for k, r in enumerate(sorted((r for r in range(len(s)) if r != q), key=lambda r: (-s[q, r], r))):
            want.setdefault((q, label[r]), k + 1)
    return want


def test_best_rank_goes_down_to_the_last_row(spark, tmp_path):
    d, s, label = embeddings(spark, tmp_path)
    want = ranks(s, range(0, len(s), 50), label)
    assert max(want.values()) > 150
    assert {(r.qid, r.label): r.best_rank for r in QUERIES["best_rank_per_label"](spark, d).collect()} == want


def test_best_ranks_in_blocks_with_ties_and_nulls(spark):
    v = np.random.default_rng(7).integers(-1, 2, size=(90, 3)) * 1.0
    v[:, 0] = 1
    label = [None if i % 11 == 0 else f"L{i % 6}" for i in range(90)]
    t = spark.createDataFrame([(i, [float(x) for x in v[i]], label[i]) for i in range(90)], "id bigint, v array<double>, label string")
    got = {(r.qid, r.label): r["rank"] for r in simjoin.best_ranks(t.filter("id % 2 = 0").select("id", "v"), t, "cosine", 6, block=16).collect()}
    assert got == ranks(cosines(v), range(0, 90, 2), label)
