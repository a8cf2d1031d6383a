"""The most similar reference fingerprints for every fingerprint, by randomly rotated one-bit codes within lists.

Fingerprints are treated as unit vectors, turned by a random rotation, of which the first dimensions are kept. Reference
vectors are put into the lists of all centres nearly as close as the closest one; a query looks into the list of its
closest centre only. Within a list, inner products are estimated from the reference's packed sign bits and one correction
scalar per vector; the error bound of that estimate says which references can be among the best, and only those are
compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import cut

STEP = 1024  # vectors unpacked to floats at a time


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / np.float32(np.sqrt(n))


class Rotation:
    """Random signs and a Hadamard transform, made from a seed; ``keep`` leading dimensions of the result, scaled so
    that inner products keep their expected value."""

    def __init__(self, dim: int, seed: int = 7):
        if dim & (dim - 1) or dim < 64:
            raise ValueError("the dimension must be a power of two of at least 64")
        self.dim, self.right = dim, 1 << dim.bit_length() // 2
        self.signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), dim)
        self.a, self.b = _hadamard(dim // self.right), _hadamard(self.right)

    def __call__(self, x: np.ndarray, keep: int) -> np.ndarray:
        rows = -(-keep // self.right)
        y = (x * self.signs).reshape(-1, self.dim // self.right, self.right) @ self.b
        return np.ascontiguousarray((self.a[:rows] @ y).reshape(len(x), -1)[:, :keep]) * np.float32(np.sqrt(self.dim / keep))


def _unit(words: np.ndarray) -> np.ndarray:
    """(n, w) 64-bit words as (n, 64 w) unit vectors."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1).astype(np.float32)
    return bits / np.sqrt(bits.sum(1, keepdims=True))


def _words(batch: pa.RecordBatch, width: int) -> tuple[pa.Array, np.ndarray]:
    """Keys and fingerprints of a batch (key, fp ARRAY<BIGINT> of ``width``), without those that have null words or no
    bit set."""
    flat = batch.column(1).flatten()
    whole = np.asarray(flat.is_valid()).reshape(-1, width).all(1)
    words = np.asarray(flat.fill_null(0)).astype(np.uint64, copy=False).reshape(-1, width)
    good = np.flatnonzero(whole & words.any(1))
    return batch.column(0).take(pa.array(good)), words[good]


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a C-ordered matrix as a binary value."""
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The reverse of _binary, for values of one size."""
    values = column.cast(pa.binary()).combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = values.chunk(0)
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(values), -1)


def fit_centres(x: np.ndarray, k: int, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """k unit centres of the rows of x by spherical k-means; empty ones keep their starting vector."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + STEP] @ centres.T).argmax(1) for i in range(0, len(x), STEP)])
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(np.bincount(own, minlength=k))
        sums = np.add.reduceat(x[order], np.searchsorted(own[order], filled), axis=0)
        centres[filled] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


class Lists:
    """Which list a vector belongs to. Up to ``most`` lists have one centre each, over the first ``dims`` rotated
    dimensions. Where more are wanted, a list is a pair of centres, the second one over the next ``dims`` dimensions, so
    that lists keep their length as the collection grows while only the sum of the two numbers of centres is fitted."""

    def __init__(self, sample: np.ndarray, rotation: Rotation, wanted: int, most: int, dims: int):
        self.rotation, self.dims = rotation, dims
        self.first = min(wanted, most, len(sample))
        self.second = min(-(-wanted // most), most, len(sample)) if 2 * dims <= rotation.dim else 1
        parts = [self._halves(_unit(sample[i : i + STEP])) for i in range(0, len(sample), STEP)]
        counts = (self.first, self.second)[: 1 + (self.second > 1)]
        self.centres = [fit_centres(np.concatenate([p[h] for p in parts]), k) for h, k in enumerate(counts)]

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        if self.second == 1:
            return [self.rotation(x, self.dims)]
        both = self.rotation(x, 2 * self.dims) * np.float32(np.sqrt(2))  # each half has about the length of the vector
        return [both[:, : self.dims], both[:, self.dims :]]

    def own(self, x: np.ndarray) -> np.ndarray:
        """The closest list of each vector."""
        at = [(h @ c.T).argmax(1) for h, c in zip(self._halves(x), self.centres)]
        return (at[0] if self.second == 1 else at[0] * self.second + at[1]).astype(np.int32)

    def near(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists nearly as close as the closest one; closeness to a pair is the mean of both."""
        scores = [h @ c.T for h, c in zip(self._halves(x), self.centres)]
        behind = [s.max(1, keepdims=True) - s for s in scores]
        if self.second == 1:
            row, at = np.nonzero(behind[0] <= np.float32(margin))
            return row, at.astype(np.int32)
        (ra, a), (rb, b) = (np.nonzero(d <= np.float32(2 * margin)) for d in behind)
        nb = np.bincount(rb, minlength=len(x))
        start = np.cumsum(nb) - nb
        n = nb[ra]  # every a of a row meets every b of it
        i = np.repeat(np.arange(len(ra)), n)
        j = start[ra[i]] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keep = behind[0][ra[i], a[i]] + behind[1][rb[j], b[j]] <= np.float32(2 * margin)
        return ra[i[keep]], (a[i[keep]] * self.second + b[j[keep]]).astype(np.int32)


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, length, and the inner product of each vector's direction with its own code vector."""
    norm = np.linalg.norm(rotated, axis=1)
    return np.packbits(rotated > 0, axis=1), norm, np.abs(rotated).sum(1) / (np.maximum(norm, 1e-12) * np.float32(np.sqrt(rotated.shape[1])))


def estimate(queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, own: np.ndarray, dim: int, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries x references) and their error bounds (one per reference). <o, q> is estimated by
    |o| <code, q> / <code, o/|o|>; ``sigmas`` deviations of the code's error and of the error of keeping
    d of ``dim`` rotated dimensions bound it."""
    d = queries.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    cosine = queries @ signs.T * (norm / (np.sqrt(np.float32(d)) * own))
    variance = np.maximum(0, 1 - own**2) / own**2 / (d - 1) + 1.5 / d * (1 - d / dim)
    return cosine, (sigmas * np.sqrt(variance)).astype(np.float32)


def _tanimoto(q: np.ndarray, r: np.ndarray, na: np.ndarray, nb: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact similarities of the pairs (x, y), so few at a time that they stay in the processor's cache."""
    shared = np.empty(len(x), np.int32)
    for i in range(0, len(x), 2048):
        shared[i : i + 2048] = np.bitwise_count(q[x[i : i + 2048]] & r[y[i : i + 2048]]).sum(1, dtype=np.int32)
    return shared / (na[x] + nb[y] - shared)


def _best_in_cell(k: int, floor: float, width: int, sigmas: float, rotation: Rotation, code_dims: int):
    def run(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], left.schema.field("key").type), "cid": pa.array([], right.schema.field("key").type), "sim": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        q, r = _matrix(left.column("fp"), np.uint64), _matrix(right.column("fp"), np.uint64)
        na, nb = np.bitwise_count(q).sum(1, dtype=np.int32), np.bitwise_count(r).sum(1, dtype=np.int32)
        codes = _matrix(right.column("code"), np.uint8)
        norm, own = right.column("norm").to_numpy().astype(np.float32), right.column("own").to_numpy().astype(np.float32)
        key = right.column("key").to_numpy()
        among = k + len(r) - len(np.unique(key))  # so many rows hold at least k different cids
        ids, cids, sims = [], [], []
        for i in range(0, len(q), STEP // 4):
            w, a = q[i : i + STEP // 4], na[i : i + STEP // 4, None]
            cosine, bound = estimate(rotation(_unit(w), code_dims), codes, norm, own, rotation.dim, sigmas)
            least = np.full(len(w), floor, np.float32)
            if len(r) > among:  # what the best ones by estimate have exactly is a threshold that k others must reach
                guess = cosine * np.sqrt(nb, dtype=np.float32)
                guess /= (a + nb).astype(np.float32)
                best = np.argpartition(guess, len(r) - among, axis=1)[:, len(r) - among :]
                least = np.maximum(least, _tanimoto(w, r, na[i : i + STEP // 4], nb, np.repeat(np.arange(len(w)), among), best.reshape(-1)).reshape(-1, among).min(1))
            # a similarity of t means a cosine of t / (1 + t) * (a + b) / sqrt(a b)
            need = (least / (1 + least) / np.sqrt(a[:, 0], dtype=np.float32)).astype(np.float32)[:, None] * (a + nb).astype(np.float32)
            need /= np.sqrt(nb, dtype=np.float32)
            x, y = np.nonzero(cosine >= need - (bound + np.float32(1e-5)))
            exact = _tanimoto(w, r, na[i : i + STEP // 4], nb, x, y)
            keep = exact >= floor
            ids.append(x[keep] + i)
            cids.append(y[keep])
            sims.append(exact[keep])
        x, y, s = np.concatenate(ids), np.concatenate(cids), np.concatenate(sims)
        if not len(x):
            return empty
        c = key[y]
        if among > k:  # the best row of each cid
            order = np.lexsort((-s, c, x))
            x, c, s = x[order], c[order], s[order]
            one = np.r_[True, (np.diff(x) != 0) | (c[1:] != c[:-1])]
            x, c, s = x[one], c[one], s[one]
        order = np.lexsort((c, -s, x))
        x, c, s = x[order], c[order], s[order]
        first = np.r_[0, np.flatnonzero(np.diff(x)) + 1]
        rank = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
        keep = rank < k
        return pa.table({"id": left.column("key").combine_chunks().take(pa.array(x[keep])), "cid": pa.array(c[keep]), "sim": pa.array(s[keep])})

    return run


def nearest_fingerprints(
    queries: DataFrame, references: DataFrame, k: int = 10, floor: float = 0.5, width: int = 32, margin: float = 0.1, sigmas: float = 3.0,
    per_list: int = 32, max_lists: int = 4096, list_dims: int = 256, code_dims: int = 1024, block: int = 4096,
) -> DataFrame:
    """(id, cid, sim): for every query the at most k references of the highest Tanimoto similarity of at least ``floor``,
    ties to the smaller cid. queries: (id, fp), references: (cid, fp), fp an ARRAY<BIGINT> of ``width`` words.

    Centres are fitted on a sample bounded by 16 * max_lists references (the smallest hashes); every reference is then
    indexed and every query asked. There is a list for each ``per_list`` references, beyond ``max_lists`` of them as pairs
    of centres, so that lists do not grow with the collection. Lists are met in cells of about ``block`` queries by ``block`` references at most, so
    that a list holding a third of all vectors is spread over many tasks; how many cells a list needs on the query side
    is told from a sample of about 5 * max_lists queries, and only decides the spreading. The result is approximate by
    the choice of one list (recall against brute force stands in the README) and the ``sigmas`` of the error bound.

    A null fp, one of another length or with null words, an all-zero fp and a null key have no neighbours and are none.
    Repeated rows of an id or cid count once; different fingerprints of one id give the better similarity. Either side
    empty: no rows.
    """
    valid = lambda df: df.select(F.col(df.columns[0]).alias("key"), "fp").filter(F.col("key").isNotNull() & (F.size("fp") == width))
    q, r = valid(queries), valid(references)
    key_q, key_r = queries.dtypes[0][1], references.dtypes[0][1]
    rotation = Rotation(64 * width)
    code_dims, list_dims = min(code_dims, rotation.dim), min(list_dims, rotation.dim)
    total = r.count()
    wanted = max(1, total // per_list)
    drawn = r.orderBy(F.xxhash64("key"), "key").limit(16 * min(wanted, max_lists)).toArrow()
    parts = [_words(b, width)[1] for b in drawn.to_batches()]
    sample = np.concatenate(parts) if parts else np.zeros((0, width), np.uint64)
    if not len(sample):
        return queries.sparkSession.createDataFrame([], f"id {key_q}, cid {key_r}, sim double")
    lists = Lists(sample, rotation, wanted, max_lists, list_dims)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, words = _words(batch, width)
            for i in range(0, len(words), STEP):
                w = words[i : i + STEP]
                yield pa.RecordBatch.from_arrays([key.slice(i, len(w)), _binary(w), pa.array(lists.own(_unit(w)))], ["key", "fp", "list"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, words = _words(batch, width)
            for i in range(0, len(words), STEP):
                w = words[i : i + STEP]
                x = _unit(w)
                row, at = lists.near(x, margin)
                code, norm, own = encode(rotation(x, code_dims))
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(row + i)), _binary(w[row]), pa.array(at), _binary(code[row]), pa.array(norm[row]), pa.array(own[row])],
                    ["key", "fp", "list", "code", "norm", "own"],
                )

    asked = f"key {key_q}, fp binary, list int"
    placed = cut(r.mapInArrow(index, f"key {key_r}, fp binary, list int, code binary, norm float, own float"))
    every = max(1, queries.count() // (5 * max_lists))
    some = q.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).mapInArrow(ask, asked)
    needs = lambda df, times: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) * times / block).cast("int").alias("n")).filter("n > 1")
    # only lists that need more than one cell: one row for each ``block`` rows at most, broadcast up to 500 000 of them
    sizes = cut(needs(placed, 1).withColumnRenamed("n", "rs").join(needs(some, every).withColumnRenamed("n", "qs"), "list", "full").select("list", F.coalesce("rs", F.lit(1)).alias("rs"), F.coalesce("qs", F.lit(1)).alias("qs")))
    if sizes.count() <= 500_000:
        sizes = F.broadcast(sizes)
    celled = lambda df: df.join(sizes, "list", "left").withColumns({"rs": F.coalesce("rs", F.lit(1)), "qs": F.coalesce("qs", F.lit(1))})
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ql = celled(q.mapInArrow(ask, asked)).withColumn("qb", part("qs")).withColumn("rb", each("rs")).select("list", "qb", "rb", "key", "fp")
    rl = celled(placed).withColumn("rb", part("rs")).withColumn("qb", each("qs")).select("list", "qb", "rb", "key", "fp", "code", "norm", "own")
    cell = ["list", "qb", "rb"]
    found = ql.groupBy(*cell).cogroup(rl.groupBy(*cell)).applyInArrow(_best_in_cell(k, floor, width, sigmas, rotation, code_dims), f"id {key_q}, cid {key_r}, sim double")
    best = found.groupBy("id", "cid").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "cid")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("id", "cid", "sim")
