"""Exact nearest neighbours: a stated query set against all rows, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten()).astype(kind, copy=False).reshape(len(flat), -1)


def _tanimoto(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    bits = lambda m: np.unpackbits(np.ascontiguousarray(m).view(np.uint8), axis=1).astype(np.float32)
    a, b = bits(q), bits(r)
    shared = np.rint(a @ b.T).astype(np.float64)
    union = a.sum(1)[:, None] + b.sum(1)[None, :] - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 0.0)


def _cosine(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return unit(q) @ unit(r).T


def _dot(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return q @ r.T


def _bayes(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of weights over the set bits of q; minus infinity where no set bit weighs more than one that was never seen."""
    bits = np.unpackbits(np.ascontiguousarray(q).view(np.uint8), axis=1, bitorder="little").astype(np.float64)
    seen = w > w.min(1, keepdims=True)
    seen |= ~seen.any(1, keepdims=True)
    return np.where(bits @ seen.T.astype(np.float64) > 0, bits @ w.T, -np.inf)


# measure, what the vectors of queries hold, what those of rows hold
MEASURES = {"tanimoto": (_tanimoto, np.uint64, np.uint64), "cosine": (_cosine, np.float64, np.float64), "dot": (_dot, np.float64, np.float64), "bayes": (_bayes, np.uint64, np.float64)}


def _in_blocks(queries: DataFrame, rows: DataFrame, work, schema: str, measure: str, digits: int, block: int) -> DataFrame:
    """What ``work`` makes of every block of queries and every block of rows, each pair of blocks in its own task. queries
    and rows are (id, vector, columns that ``work`` reads); null ids, null vectors and vectors with nulls are left out.

    ``work(left, right, parts)`` gets both blocks ordered by id, so that a later pass over the same blocks finds the very
    same similarities; parts yields (number of the first query, similarities of up to 512 queries to all rows of the
    block, rounded to ``digits``) and nothing if a side is empty.
    """
    score, kind_q, kind_r = MEASURES[measure]
    clean = lambda d: d.select(F.col(d.columns[0]).alias("id"), F.col(d.columns[1]).alias("v"), *d.columns[2:]).filter("id is not null and v is not null").filter(~F.exists("v", lambda x: x.isNull()))
    q, r = clean(queries), clean(rows)
    nq, nr = max(1, -(-q.count() // block)), max(1, -(-r.count() // block))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", part(nq)).withColumn("rb", each(nr))
    r = r.withColumn("rb", part(nr)).withColumn("qb", each(nq))

    def task(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("id"), right.sort_by("id")
        if not (left.num_rows and right.num_rows):
            return work(left, right, ())
        a, b = _matrix(left.column("v"), kind_q), _matrix(right.column("v"), kind_r)
        return work(left, right, ((i, np.round(score(a[i : i + 512], b), digits)) for i in range(0, len(a), 512)))

    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(task, schema)


def _joined(arrays: list, kind: type = np.int64) -> np.ndarray:
    return np.concatenate(arrays).astype(kind, copy=False) if arrays else np.zeros(0, kind)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value of both columns, equal for equal ones; nulls are one value."""
    x = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    codes = pc.fill_null(x.dictionary_encode().indices, -1).to_numpy()
    return codes[: len(a)], codes[len(a) :]


def _kind(d: DataFrame, at: int = 0) -> str:
    return d.dtypes[at][1]


def nearest(queries: DataFrame, rows: DataFrame, k: int, floor: float = -2.0, measure: str = "tanimoto", digits: int = 12, block: int = 4096, others: bool = False, less: str | None = None, below: float = np.inf, apart: str | None = None) -> DataFrame:
    """(qid, rid, sim, rk): for each query the k most similar rows of at least ``floor``, by falling similarity (rounded
    to ``digits``), then id. queries and rows are (id, vector); all vectors have one length. With ``others`` a query never
    meets a row of its own id; else the caller filters it out afterwards (ask for k + 1). Nor does it meet rows that are
    not ``below`` or, with ``apart``, rows with the same value of that column of both sides (nulls are the same). These
    hold before the k are taken, so what they exclude is made up for. ``less`` names a column of rows that is subtracted
    from the similarity before anything is ranked (and the difference rounded).

    Both sides are cut into blocks of about ``block`` and every query block meets every row block in its own task, which
    keeps its best k; those are merged by one ranking. Null ids, null vectors and vectors with nulls are left out.
    """

    def best(left: pa.Table, right: pa.Table, parts) -> pa.Table:
        li, ri = left.column("id").to_numpy(), right.column("id").to_numpy()
        off = right.column(less).to_numpy() if less else None
        lg, rg = _codes(left.column(apart), right.column(apart)) if apart else (None, None)
        out_x, out_c, out_s = [], [], []
        for i, s in parts:
            s = s if off is None else np.round(s - off, digits)
            for j, row in enumerate(s):
                ok = (row >= floor) & (row < below)
                if others:
                    ok &= ri != li[i + j]
                if apart:
                    ok &= rg != lg[i + j]
                at = np.flatnonzero(ok)
                if len(at) > k:
                    at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((ri[at], -row[at]))][:k]
                out_x.append(np.full(len(at), i + j))
                out_c.append(at)
                out_s.append(row[at])
        return pa.table({"qid": left.column("id").take(pa.array(_joined(out_x))), "rid": right.column("id").take(pa.array(_joined(out_c))), "sim": pa.array(_joined(out_s, float))})

    found = _in_blocks(queries, rows, best, f"qid {_kind(queries)}, rid {_kind(rows)}, sim double", measure, digits, block)
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), "rid")
    return found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def count_within(queries: DataFrame, rows: DataFrame, floors: dict[str, float], measure: str = "tanimoto", digits: int = 12, block: int = 4096) -> DataFrame:
    """(qid, a column for each name in ``floors``): how many of all rows are at least as similar as its floor. Every pair
    of blocks gives counts, which are summed; nothing is ranked or cut."""

    def count(left: pa.Table, right: pa.Table, parts) -> pa.Table:
        n: dict[str, list] = {name: [] for name in floors}
        for _, s in parts:
            for name, floor in floors.items():
                n[name].append((s >= floor).sum(1))
        ids = left.column("id") if right.num_rows else left.column("id").slice(0, 0)
        return pa.table({"qid": ids} | {name: pa.array(_joined(x)) for name, x in n.items()})

    found = _in_blocks(queries, rows, count, ", ".join([f"qid {_kind(queries)}", *(f"{name} bigint" for name in floors)]), measure, digits, block)
    return found.groupBy("qid").agg(*[F.sum(name).alias(name) for name in floors])


def label_sums(queries: DataFrame, rows: DataFrame, floor: float, measure: str = "tanimoto", digits: int = 12, block: int = 4096) -> DataFrame:
    """(qid, label, raw, square, n): for each query and label the sum of the similarities from ``floor`` on over all rows
    with the label, that of their squares, and their number. rows are (id, vector, labels), labels an array. The row whose
    label is null is over all rows, with labels or without, and its n counts every row compared, also those below.
    """
    name = rows.columns[2]

    def add(left: pa.Table, right: pa.Table, parts) -> pa.Table:
        lists = right.column(name)
        each = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        flat = pc.list_flatten(lists).dictionary_encode().unify_dictionaries().combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        code, start, many = flat.indices.to_numpy(), np.cumsum(each) - each, max(1, len(flat.dictionary))
        out_x, out_c, sums = [], [], []
        for i, s in parts:
            x, y = np.nonzero(s >= floor)
            v = s[x, y]
            all_x = np.arange(len(s))
            out_x.append(i + all_x)
            out_c.append(np.full(len(s), -1))
            sums.append((np.bincount(x, v, len(s)), np.bincount(x, v * v, len(s)), np.full(len(s), s.shape[1])))
            n = each[y]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair, v = np.repeat(x, n) * many + code[np.repeat(start[y], n) + within], np.repeat(v, n)
            key, at, n = np.unique(pair, return_inverse=True, return_counts=True)
            out_x.append(i + key // many)
            out_c.append(key % many)
            sums.append((np.bincount(at, v, len(key)), np.bincount(at, v * v, len(key)), n))
        raw, square, n = zip(*sums, strict=True) if sums else ([], [], [])
        c = _joined(out_c)
        return pa.table({"qid": left.column("id").take(pa.array(_joined(out_x))), "label": flat.dictionary.take(pa.array(c, mask=c < 0)), "raw": pa.array(_joined(raw, float)), "square": pa.array(_joined(square, float)), "n": pa.array(_joined(n))})

    kind = dict(rows.dtypes)[name].removeprefix("array<").removesuffix(">")
    found = _in_blocks(queries, rows, add, f"qid {_kind(queries)}, label {kind}, raw double, square double, n bigint", measure, digits, block)
    return found.groupBy("qid", "label").agg(*[F.sum(c).alias(c) for c in ("raw", "square", "n")])


def mean_similarity(queries: DataFrame, rows: DataFrame, measure: str = "tanimoto", digits: int = 12, block: int = 4096) -> DataFrame:
    """(rid, mean): the mean similarity of each row to all queries of another id. Sums are kept in whole units of the last
    digit, so that the order of the blocks changes nothing; ``digits`` of 6 leave room for 9 * 10**12 queries."""

    def add(left: pa.Table, right: pa.Table, parts) -> pa.Table:
        li, ri = left.column("id").to_numpy(), right.column("id").to_numpy()
        total, n = np.zeros(len(ri), np.int64), np.zeros(len(ri), np.int64)
        for i, s in parts:
            other = li[i : i + len(s), None] != ri[None, :]
            total += np.where(other, np.rint(s * 10.0**digits), 0).astype(np.int64).sum(0)
            n += other.sum(0)
        return pa.table({"rid": right.column("id"), "total": pa.array(total), "n": pa.array(n)})

    found = _in_blocks(queries, rows, add, f"rid {_kind(rows)}, total bigint, n bigint", measure, digits, block)
    sums = found.groupBy("rid").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0")
    return sums.select("rid", (F.col("total") / F.col("n") / F.lit(10.0**digits)).alias("mean"))


def best_ranks(queries: DataFrame, rows: DataFrame, measure: str = "tanimoto", digits: int = 12, block: int = 4096) -> DataFrame:
    """(qid, label, rank): the place of each label's first row among all rows but the query's own, by falling similarity,
    then id. rows are (id, vector, label); a null is a label. The first pass over the blocks finds each label's first row,
    the second counts the rows before it.
    """
    name, ids, kind = rows.columns[2], _kind(rows), _kind(rows, 2)

    def first(left: pa.Table, right: pa.Table, parts) -> pa.Table:
        li, ri = left.column("id").to_numpy(), right.column("id").to_numpy()
        codes, _ = _codes(right.column(name), right.column(name).slice(0, 0))
        out_x, out_c, out_s = [], [], []
        for i, s in parts:
            for j, row in enumerate(s):
                order = np.lexsort((ri, -row))
                order = order[ri[order] != li[i + j]]
                at = order[np.unique(codes[order], return_index=True)[1]]
                out_x.append(np.full(len(at), i + j))
                out_c.append(at)
                out_s.append(row[at])
        at = pa.array(_joined(out_c))
        return pa.table({"qid": left.column("id").take(pa.array(_joined(out_x))), "label": right.column(name).take(at), "sim": pa.array(_joined(out_s, float)), "rid": right.column("id").take(at)})

    tops = _in_blocks(queries, rows, first, f"qid {_kind(queries)}, label {kind}, sim double, rid {ids}", measure, digits, block)
    tops = tops.groupBy("qid", "label").agg(F.min(F.struct((-F.col("sim")).alias("o"), "rid", "sim")).alias("b"))
    return _counted_before(queries, rows, tops.select("qid", "label", "b.sim", "b.rid"), measure, digits, block)


def ranks_of(queries: DataFrame, rows: DataFrame, wanted: DataFrame, measure: str = "tanimoto", digits: int = 12, less: str | None = None, block: int = 4096) -> DataFrame:
    """(qid, label, rank): the place of each wanted row (query id, row id) among all rows, by falling similarity, then id;
    ``less`` names a column of rows subtracted from the similarity first. Queries and rows that are asked for but not there
    have no rank. The similarity of the wanted pairs is taken in one pass over the blocks, the rows before them are counted
    in another."""
    named = wanted.toDF("qid", "rid").groupBy("qid").agg(F.collect_set("rid").alias("wanted")).withColumnRenamed("qid", queries.columns[0])
    asked = queries.join(named, queries.columns[0])

    def own(left: pa.Table, right: pa.Table, parts) -> pa.Table:
        where = {x: i for i, x in enumerate(right.column("id").to_pylist())}
        off = right.column(less).to_numpy() if less else None
        lists = left.column("wanted").to_pylist()
        out_x, out_c, out_s = [], [], []
        for i, s in parts:
            s = s if off is None else np.round(s - off, digits)
            for j, row in enumerate(s):
                at = np.array([where[x] for x in lists[i + j] if x in where], np.int64)
                out_x.append(np.full(len(at), i + j))
                out_c.append(at)
                out_s.append(row[at])
        rid = right.column("id").take(pa.array(_joined(out_c)))
        return pa.table({"qid": left.column("id").take(pa.array(_joined(out_x))), "label": rid, "sim": pa.array(_joined(out_s, float)), "rid": rid})

    kind = _kind(rows)
    found = _in_blocks(asked, rows, own, f"qid {_kind(queries)}, label {kind}, sim double, rid {kind}", measure, digits, block)
    return _counted_before(queries, rows, found, measure, digits, block, others=False, less=less)


def _counted_before(queries: DataFrame, rows: DataFrame, tops: DataFrame, measure: str, digits: int, block: int, others: bool = True, less: str | None = None) -> DataFrame:
    """(qid, label, rank) of tops (qid, label, sim, rid): one more than the rows that come before (sim, rid)."""
    kind = dict(tops.dtypes)["label"]

    def before(left: pa.Table, right: pa.Table, parts) -> pa.Table:
        li, ri = left.column("id").to_numpy(), right.column("id").to_numpy()
        off = right.column(less).to_numpy() if less else None
        flat = pc.list_flatten(left.column("best")).combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        ends = np.cumsum(pc.list_value_length(left.column("best")).to_numpy())
        sims, rids = flat.field("sim").to_numpy(), flat.field("rid").to_numpy(zero_copy_only=False)
        n = np.zeros(len(flat) if right.num_rows else 0, np.int64)
        for i, s in parts:
            s = s if off is None else np.round(s - off, digits)
            for j, row in enumerate(s):
                mine = slice(ends[i + j - 1] if i + j else 0, ends[i + j])
                m, other = mine.stop - mine.start, ri != li[i + j] if others else np.ones(len(ri), bool)
                order = np.lexsort((np.arange(m + other.sum()) >= m, np.concatenate([rids[mine], ri[other]]), -np.concatenate([sims[mine], row[other]])))
                passed = np.cumsum(order >= m)
                n[mine][order[order < m]] = passed[order < m]
        x = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(n)]
        return pa.table({"qid": left.column("id").take(pa.array(x)), "label": flat.field("label").slice(0, len(n)), "n": pa.array(n)})

    best = tops.groupBy("qid").agg(F.collect_list(F.struct("label", "sim", "rid")).alias("best"))
    asked = queries.join(best.withColumnRenamed("qid", queries.columns[0]), queries.columns[0]).select(*queries.columns[:2], "best")
    found = _in_blocks(asked, rows.select(*rows.columns[:2], *[less] * bool(less)), before, f"qid {_kind(queries)}, label {kind}, n bigint", measure, digits, block)
    return found.groupBy("qid", "label").agg((F.sum("n") + 1).alias("rank"))
