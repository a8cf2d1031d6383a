"""Splitting oversized texts at natural boundaries, with an overlap between neighbouring pieces."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\S+")
_PARAGRAPH = re.compile(r"\S(?=[^\S\n]*(?:\r?\n[^\S\n]*){2,}|[^\S\n]*</p>|\s*\r?\n\s*(?:[-*•]|\(?\d+[.)])\s)")
_SENTENCE = re.compile(r"[.!?。！？][\"')\]»”]*(?=\s|$)|[。！？]")


def split_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, how) of the pieces of ``text``, in code points; how is 'paragraph', 'sentence', 'word', 'hard' or
    'end', what the piece's end is.

    Token offsets and the sorted ends of paragraphs, sentences and words are laid out once; each piece ends at the last
    paragraph end in the second half of its room, else the last sentence end there, else the last word end, found by
    binary search. The next piece starts at the first word start within ``overlap`` characters before that end. A token
    with no end in reach is cut hard, which happens only in a stretch without white space longer than ``limit``; where
    the overlap would push a token out of reach it is left out. Pieces together hold every character but white space
    between pieces. A text within the limit is one piece, an empty one gives none.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap smaller")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    starts, ends = [], []
    for m in _WORD.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    levels = (("paragraph", [m.end() for m in _PARAGRAPH.finditer(text)], 0.5), ("sentence", [m.end() for m in _SENTENCE.finditer(text)], 0.5), ("word", ends, 0.0))
    out, at, done = [], starts[0] if starts else 0, 0  # done: end of the last piece; a piece must end beyond it
    while True:
        reach = at + limit
        if reach >= n or not ends or ends[-1] <= reach:
            out.append((at, n if n - at <= limit else reach, "end"))
            return out
        for how, marks, share in levels:
            i = bisect_right(marks, reach) - 1
            if i >= 0 and marks[i] > max(done, at + int(limit * share)):
                end = marks[i]
                break
        else:
            how, end = "hard", reach
        out.append((at, end, how))
        i = bisect_left(starts, end - overlap)
        nxt = starts[i] if i < len(starts) and starts[i] < end else (end - overlap if how == "hard" else None)
        following = bisect_right(ends, end)
        if following == len(ends):
            return out
        if nxt is None or nxt <= at or ends[following] > nxt + limit:
            inside = starts[following] < end
            nxt = end if inside else starts[following]
            if inside and ends[following] - end > limit - overlap:
                nxt = end - overlap if ends[following] - end > limit else end
        at, done = nxt, end


def split_texts(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """(keys, piece, start, end, how[, text]): the pieces of every text longer than ``limit`` code points.

    Null and shorter texts have no rows (they need no cut); rows keep their keys, repeated rows are split again. Texts
    are cut whole, one row at a time: memory is one Arrow batch of texts.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece int, start int, end int, how string" + (", text string" if with_text else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for *key, t in frame.itertuples(index=False, name=None):
                for i, (a, b, how) in enumerate(split_spans(t, limit, overlap)):
                    rows.append((*key, i, a, b, how, t[a:b]) if with_text else (*key, i, a, b, how))
            yield pd.DataFrame(rows, columns=[*keys, "piece", "start", "end", "how", *["text"] * with_text])

    return df.filter(F.length(text) > limit).select(*keys, text).mapInPandas(run, schema)
