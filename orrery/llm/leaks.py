"""Evaluation passages leaking into training text: a block-max BM25 index of the test items, queried by every passage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.lookalike import skeleton

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, without case and without differences that cannot be seen."""
    return _WORD.findall(skeleton(text).lower())


def _run_hashes(ids: np.ndarray, run: int) -> np.ndarray:
    """Hash of every ``run`` consecutive word ids; the last run - 1 places have none."""
    n = len(ids) - run + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        for i in range(run):
            out = out * np.uint64(0xD1342543DE82EF95) + mixed[i : i + max(0, n)]
    return out


SLACK = np.float32(1 - 1e-4)


def _mixed(hashes: np.ndarray, items: np.ndarray) -> np.ndarray:
    """One number for a run of words in an item."""
    with np.errstate(over="ignore"):
        return hashes ^ ((items.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))


class ItemIndex:
    """Inverted index of test items: the postings (term, item) in order with their BM25 weights, the greatest weight of
    every term, and beside each posting that of its term within its block of ``block`` items. All arrays grow with the
    postings, none with terms times items.

    Weights are divided by each item's own threshold, the least weight that ``run`` consecutive words of it can have. A
    passage that holds such a run scores at least 1 for the item, so no item that leaks is missed, and a passage whose
    words are worth less than the cheapest run of an item is not compared with it."""

    def __init__(self, items: list[tuple[int, str]], run: int = 12, block: int = 64, k1: float = 1.2, b: float = 0.75):
        kept = [(i, w) for i, t in items if len(w := words_of(t)) >= run]
        self.run, self.block, self.n = run, block, max(1, len(kept))
        self.vocab: dict[str, int] = {}
        seqs = [np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64) for _i, w in kept]
        self.ids = [i for i, _w in kept]
        self.none = len(self.vocab)  # stands for no term
        df = np.bincount(np.concatenate([np.unique(s) for s in seqs]), minlength=self.none) if seqs else np.zeros(0)
        idf = np.log(1 + (len(seqs) - df + 0.5) / (df + 0.5))
        mean = sum(map(len, seqs)) / max(1, len(seqs))
        keys, weights, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], [np.zeros(0, np.uint64)]
        for at, s in enumerate(seqs):
            terms, place, f = np.unique(s, return_inverse=True, return_counts=True)
            w = idf[terms] * f * (k1 + 1) / (f + k1 * (1 - b + b * len(s) / mean))
            runs = np.sort(np.lib.stride_tricks.sliding_window_view(place, run), axis=1)
            first = np.diff(runs, axis=1, prepend=-1) > 0  # each term of a run once
            keys.append(terms * self.n + at)
            weights.append((w / (w[runs] * first).sum(1).min()).astype(np.float32))
            marks.append(_mixed(_run_hashes(s, run), np.full(len(runs), at)))
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(keys, kind="stable")
        self.keys, self.weights, self.marks = keys[order], weights[order], np.unique(np.concatenate(marks))
        term, item = self.keys // self.n, self.keys % self.n
        starts = np.flatnonzero(np.diff(term * (self.n // block + 1) + item // block, prepend=-1))
        size = np.diff(np.r_[starts, len(term)])
        self.block_tops = np.repeat(np.maximum.reduceat(self.weights, starts), size) if len(starts) else self.weights
        self.starts = np.searchsorted(self.keys, np.arange(self.none + 1) * self.n)  # of each term's postings
        self.tops = np.zeros(self.none + 1, np.float32)
        np.maximum.at(self.tops, term, self.weights)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.weights, self.block_tops, self.starts, self.tops, self.marks))

    def _seek(self, terms: np.ndarray, item: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """(place in the postings, item) of each term's first posting at or after ``item``; item n if there is none."""
        return self._at(terms, np.searchsorted(self.keys, terms * self.n + item))

    def _at(self, terms: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return at, np.where((at < len(self.keys)) & (key < (terms + 1) * self.n), key - terms * self.n, self.n)

    def candidates(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of all scores of 1 or more, by block-max WAND. terms: a row of different terms for each
        passage, filled up with ``none``. All passages move their cursors together: those are sorted by their item, the
        pivot is where the greatest weights first add up to 1; if the block maxima there do not, the cursors jump behind
        the block, else they meet at the pivot, which is scored."""
        out_p, out_i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        p = np.flatnonzero(self.tops[terms].sum(1) >= SLACK)
        t, last = terms[p], len(self.keys) - 1
        pos, cur = self._at(t, self.starts[t])
        while len(p):
            order = np.argsort(cur, axis=1, kind="stable")
            t, pos, cur = (np.take_along_axis(x, order, 1) for x in (t, pos, cur))
            reach = np.cumsum(np.where(cur < self.n, self.tops[t], np.float32(0)), axis=1) >= SLACK
            live = reach[:, -1]
            p, t, pos, cur, reach = (x[live] for x in (p, t, pos, cur, reach))
            pivot = np.take_along_axis(cur, reach.argmax(1)[:, None], 1)
            upto = cur <= pivot
            x, y = np.nonzero(upto)
            # a cursor still in an earlier block is bounded by its term's greatest weight
            near = cur[x, y] // self.block == pivot[x, 0] // self.block
            bound = np.bincount(x, np.where(near, self.block_tops[np.minimum(pos[x, y], last)], self.tops[t[x, y]]), len(p))
            good = bound >= SLACK
            level = good & (cur[:, 0] == pivot[:, 0])
            there = np.flatnonzero(level[x])
            score = np.bincount(x[there], self.weights[pos[x[there], y[there]]], len(p))
            hit = level & (score >= SLACK)
            out_p.append(p[hit])
            out_i.append(pivot[hit, 0])
            behind = np.minimum((pivot[:, 0] // self.block + 1) * self.block, np.where(upto, self.n, cur).min(1))
            target = np.where(level, pivot[:, 0] + 1, np.where(good, pivot[:, 0], behind))
            move = cur[x, y] < target[x]
            x, y = x[move], y[move]
            one = cur[x, y] + 1 == target[x]  # from a posting to the one after it no search is needed
            step, far = (x[one], y[one]), (x[~one], y[~one])
            pos[step], cur[step] = self._at(t[step], pos[step] + 1)
            pos[far], cur[far] = self._seek(t[far], target[far[0]])
        return np.concatenate(out_p), np.concatenate(out_i)


def _search(shared, window: int):
    """shared: a broadcast ItemIndex."""

    def one(keys: list, texts: list[str]) -> list[tuple]:
        index: ItemIndex = shared.value
        run, get = index.run, index.vocab.get
        flat, ends = [], []
        for t in texts:
            flat += [get(w, -1) for w in words_of(t)]
            flat.append(-1)  # no run goes over the end of a text
            ends.append(len(flat))
        ids = np.array(flat + [-1] * run, np.int64)
        # places where run known words begin; only these words can be part of a leak
        known = np.r_[0, np.cumsum(ids >= 0)]
        starts = np.flatnonzero(known[run:] - known[:-run] == run)
        if not len(starts) or not len(index.keys):
            return []
        # passages: up to window - run + 1 consecutive such places, so each run lies whole in one passage
        opens = np.r_[True, np.diff(starts) > 1]
        first = np.maximum.accumulate(np.where(opens, np.arange(len(starts)), 0))
        opens |= (np.arange(len(starts)) - first) % (window - run + 1) == 0
        begin = np.flatnonzero(opens)
        count = np.diff(np.r_[begin, len(starts)])
        place = starts[begin][:, None] + np.arange(window)
        inside = np.arange(window) < (count + run - 1)[:, None]
        terms = np.sort(np.where(inside, ids[np.minimum(place, len(ids) - 1)], index.none), axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = index.none
        p, i = index.candidates(terms)
        if not len(p):
            return []
        # verification: the candidate's passage and item share a run of words
        n = count[p]
        of = np.repeat(np.arange(len(p)), n)
        at = starts[np.repeat(begin[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        marks = _mixed(_run_hashes(ids, run)[at], i[of])
        found = index.marks[np.minimum(np.searchsorted(index.marks, marks), len(index.marks) - 1)] == marks
        doc = np.searchsorted(ends, at[found], side="right")
        return sorted({(keys[d], index.ids[j]) for d, j in zip(doc.tolist(), i[of[found]].tolist())})

    def run_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 5000):
                part = frame.iloc[i : i + 5000]
                yield pd.DataFrame(one(part.doc.tolist(), part.text.tolist()), columns=["doc_id", "item_id"])

    return run_frames


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 12, window: int = 24, items_at_once: int = 50_000) -> DataFrame:
    """(doc_id, item_id) of documents (doc_id, text) that hold at least ``run`` consecutive words of the passage of an
    item (item_id, passage); each pair once.

    Of a document only stretches of at least ``run`` words that items know are looked at, cut into passages of up to
    ``window`` words overlapping by run - 1, so that every run lies whole in one. Each passage asks the index for all
    items scoring at least their threshold, and the runs shared with those are then compared. The index is made once and
    broadcast (some 25 bytes a different word of an item and 8 a run); the corpus is read once and never shuffled. Test
    sets of more than ``items_at_once`` items are searched in parts of that size, each reading the corpus again, so that
    what is broadcast has a bound. Null texts, passages and keys and passages of fewer than ``run`` words leak nothing;
    an empty side gives no rows.
    """
    if window < run:
        raise ValueError("a passage must hold a run")
    kind_d, kind_i = docs.dtypes[0][1], items.dtypes[0][1]
    d = docs.select(F.col(docs.columns[0]).alias("doc"), F.col("text")).filter("doc is not null and text is not null")
    t = items.select(F.col(items.columns[0]).alias("item"), F.col("passage")).filter("item is not null and passage is not null").distinct()
    parts = max(1, -(-t.count() // items_at_once))
    out = None
    for part in range(parts):
        some = [(r.item, r.passage) for r in t.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toLocalIterator()]
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(some, run))
        found = d.mapInPandas(_search(index, window), f"doc_id {kind_d}, item_id {kind_i}")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
