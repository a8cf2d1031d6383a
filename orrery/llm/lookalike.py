"""One consistent form for texts that look alike but differ in their characters."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import cut

SCRIPTS = ("latin", "cyrillic", "greek", "armenian")
# Letters of the same shape in the scripts, in the order of SCRIPTS, a part of the Unicode table of
# confusable characters (UTS #39); '-' where a script has none. Symbols that can be told apart (alpha beside a) are not
# in it.
LOOKALIKES = """
A А Α -
B В Β -
C С Ϲ -
E Е Ε -
F - Ϝ -
G Ԍ - -
H Н Η -
I ІӀ Ι -
J Ј Ϳ -
K К Κ -
M М Μ -
N - Ν -
O О Ο Օ
P Р Ρ -
Q Ԛ - -
S Ѕ - Տ
T Т Τ -
U - - Ս
V Ѵ - -
W Ԝ - -
X Х Χ -
Y УҮ Υ -
Z - Ζ -
a а - -
c с ϲ -
d ԁ - -
e е - -
g - - ց
h һ - հ
i і ι -
j ј ϳ -
l ӏ - -
n - - ո
o о ο օ
p р ρ -
q ԛ - զ
s ѕ - -
u - υ ս
v ѵ ν -
w ԝ - -
x х χ -
y уү - -
"""
CLASSES = [["" if x == "-" else x for x in line.split()] for line in LOOKALIKES.split("\n") if line]
# Letters that look like one or another Latin letter; which one is meant, the lattice decides.
SEVERAL = {"Ӏ": "Il", "ӏ": "lI"}
MEMBERS = {row[0]: row for row in CLASSES}
SKELETON = {ord(c): row[0] for row in CLASSES for c in "".join(row)}
FOREIGN_LIKE = {c: t for c, t in SKELETON.items() if chr(c) != t}
TWINS = {c: t for c, t in FOREIGN_LIKE.items() if chr(c) not in SEVERAL}  # one reading only


# Format characters that are drawn.
VISIBLE_FORMATS = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


def _compatible() -> dict[int, str | None]:
    """Characters that are replaced or deleted whatever stands beside them: full- and half-width forms become plain
    ones, blanks one blank, characters without a mark of their own vanish. Superscripts and symbols stay."""
    out: dict[int, str | None] = {}
    for i in [*range(0xFF01, 0xFFE7), 0xB5]:
        out[i] = unicodedata.normalize("NFKC", chr(i))
    for i in range(0x80, sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))
        if kind == "Zs":
            out[i] = " "
        elif kind == "Cf" and i not in VISIBLE_FORMATS or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or i in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            out[i] = None
    return out


COMPATIBLE = _compatible()
_TOKEN = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")
_MARKS = re.compile(r"[̀-ͯ]+")


LAST = 0x590  # no letter of the scripts lies beyond


def _block(c: str) -> int | None:
    """Index in SCRIPTS of any letter of the script."""
    o = ord(c)
    if o < 0x250:
        return 0 if c.isalpha() else None
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return 2
    return 1 if 0x400 <= o < 0x530 else 3 if 0x531 <= o < 0x588 else None


def script_of(c: str) -> int | None:
    """Index in SCRIPTS of an unambiguous letter; None for look-alikes, the sign of micro (it stands in texts of all
    scripts) and everything else."""
    return None if ord(c) in SKELETON or c == "μ" else _block(c)


_SCRIPT_CACHE = {chr(i): script_of(chr(i)) for i in [*range(0x250), *range(0x370, LAST)]}
_NOT_ASCII = re.compile(r"[^\x00-\x7f\u0300-\u036f]")  # marks aside
_FOREIGN = re.compile(r"[\u0370-\u03bb\u03bd-\u0590\u1f00-\u1fff]")  # without the sign of micro


def _class(points: Iterable[int]) -> str:
    """A character class of code points, with ranges."""
    out, run = [], []
    for i in [*sorted(points), -1]:
        if run and i != run[-1] + 1:
            out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
            run = []
        run.append(i)
    return f"[{''.join(out)}]"


_REPLACED = re.compile(_class(COMPATIBLE))


def compatible_form(text: str) -> str:
    """Full-width forms, blanks and ignorable characters unified; accents decomposed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", _REPLACED.sub(lambda m: COMPATIBLE[ord(m[0])] or "", text))


def skeleton(text: str) -> str:
    """The compatible form with every look-alike letter replaced by its Latin twin, accents composed."""
    if text.isascii():
        return text
    plain = compatible_form(text)
    return unicodedata.normalize("NFC", plain.translate(FOREIGN_LIKE) if _FOREIGN.search(plain) else plain)


class Lattice:
    """Chooses one letter per look-alike position of a token. What it chooses depends on the classes of the letters,
    never on which member of a class was typed, so that texts that look alike get the same form. A letter that looks
    like two others is read as the one that gives the likelier token; this reading decides what the text equals."""

    SWITCH, PRIOR = -25.0, 20.0

    def __init__(self, bigrams: dict[tuple[str, str], int] | None = None):
        self.pairs = bigrams or {}
        self.ones: Counter = Counter()
        for (a, b), n in self.pairs.items():
            self.ones[a] += n
            self.ones[b] += 0
        # letters may be written in a script that some text has, the letters of several readings only if they were seen
        scripts = {s for c in self.ones for s in range(len(SCRIPTS)) if _block(c) == s} | {0}
        seen = lambda i, x: not self.pairs or x in self.ones or (i in scripts and x not in SEVERAL)
        self.options = {c: [(i, x) for i, xs in enumerate(row) for x in xs if seen(i, x)] for c, row in MEMBERS.items()}
        for c, readings in SEVERAL.items():
            self.options[c] = [o for x in readings for o in self.options[x]]
        # Latin letters that can be written in another script; a token of no others and no marks is open
        self.other = [sets for i in range(1, len(SCRIPTS)) if (sets := "".join(c for c in MEMBERS if any(s == i for s, _x in self.options[c])))]
        run = "|".join(f"(?:[{x}]{_MARKS.pattern[:-1]}*+)++" for x in self.other) or "(?!)"
        self.open = re.compile(rf"(?<![^\W\d_])(?<!{_MARKS.pattern[:-1]})(?:{run})(?![^\W\d_]|{_MARKS.pattern[:-1]})")
        self.cache: dict[tuple[int, str], str] = {}

    def _step(self, a: str, b: str) -> float:
        return math.log((self.pairs.get((a, b), 0) + 0.5) / (self.ones.get(a, 0) + 64.0))

    def viterbi(self, token: str, home: int) -> str:
        """The best path: each position may take the class member of any script, other letters stay. A change of script
        within the token costs SWITCH, each letter is scored by the one before it, the text's own script gains PRIOR."""
        best: dict[tuple[int, str], tuple[float, str]] = {}  # (script, letter): score, path
        for c in token:
            if _MARKS.fullmatch(c):
                best = {at: (v, p + c) for at, (v, p) in best.items()}
                continue
            own = _SCRIPT_CACHE.get(c)
            here = self.options.get(c) or ([(own, c)] if own is not None else [(s, c) for s in range(len(SCRIPTS))])
            nxt = {}
            for s, x in sorted(here):
                if best:
                    v, _order, p = max((v + (self._step(y, x) if r == s else self.SWITCH + self._step("^", x)), (-r, y), p) for (r, y), (v, p) in best.items())
                else:
                    v, p = self._step("^", x) + (self.PRIOR if s == home else 0.0), ""
                nxt[s, x] = (v, p + x)
            best = nxt
        return max((v, -s, p) for (s, _x), (v, p) in best.items())[2]

    def token(self, token: str, home: int) -> str:
        """token: with TWINS applied. One with letters that only Latin has stays Latin without a search."""
        out = self.cache.get((home, token))
        if out is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            settled = not _NOT_ASCII.search(token) and not self.open.fullmatch(token)
            out = self.cache[home, token] = token if settled else self.viterbi(token, home)
        return out

    def text(self, text: str) -> str:
        """The consistent form of a whole text; its own script is the one of most unambiguous letters."""
        plain, home = compatible_form(text), 0
        if _FOREIGN.search(plain) and _FOREIGN.search(plain := plain.translate(TWINS)):
            count = Counter()
            for c, n in Counter(plain).items():
                if (s := _SCRIPT_CACHE.get(c)) is not None:
                    count[s] += n
            home = min(range(len(SCRIPTS)), key=lambda s: (-count[s], s))
            plain = _TOKEN.sub(lambda m: self.token(m[0], home), plain)
        else:
            plain = self.open.sub(lambda m: self.token(m[0], 0), plain)
        return plain if plain.isascii() else unicodedata.normalize("NFC", plain)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point below LAST: 0 no letter, 1 a letter without evidence, 2 << s one of script s; and the letter's
    member in each script."""
    kind, to = np.zeros(LAST, np.uint8), np.tile(np.arange(LAST, dtype=np.int32), (len(SCRIPTS), 1))
    for i in range(LAST):
        s = _SCRIPT_CACHE.get(chr(i))
        kind[i] = 0 if not chr(i).isalpha() else 1 if s is None else 2 << s
    for c, twin in SKELETON.items():
        for s, members in enumerate(MEMBERS[twin]):
            if members and chr(c) not in members:
                to[s, c] = ord(members[0])
    return kind, to.reshape(-1)


def _pair_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kind, to = _tables()
    counts = np.zeros(LAST * LAST, np.int64)
    for frame in frames:
        joined = "\n".join(t if t.isascii() else compatible_form(t) for t in frame.text)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.minimum(cp, LAST - 1).astype(np.int32)  # the last one is no letter
        if not joined.isascii():
            cp = cp[(cp < 0x300) | (cp >= 0x370)]
        k = kind[cp]
        at = np.flatnonzero(k)
        if not len(at):
            continue
        first = np.r_[True, np.diff(at) > 1]
        starts = np.flatnonzero(first)
        seen = np.bitwise_or.reduceat(k[at] & 0xFE, starts)
        one = (seen != 0) & (seen & (seen - 1) == 0)
        script = np.log2(np.maximum(seen, 2)).astype(np.int32) - 1
        size = np.diff(np.r_[starts, len(at)])
        keep, of = np.repeat(one, size), np.repeat(script[one], size[one])
        letter = to[of * LAST + cp[at[keep]]]
        before = np.r_[0, letter[:-1]].astype(np.int32)
        before[first[keep]] = 0  # 0 stands for the start of a token
        counts += np.bincount(before * LAST + letter, minlength=LAST * LAST)
    some = np.flatnonzero(counts)
    yield pd.DataFrame([("^" if i < LAST else chr(i // LAST), chr(i % LAST), n) for i, n in zip(some.tolist(), counts[some].tolist())], columns=["a", "b", "n"])


def letter_pairs(docs: DataFrame) -> dict[tuple[str, str], int]:
    """How often a letter follows another within tokens of one evident script, over all texts. Only letters below LAST
    count, so the table has a bounded number of entries whatever the corpus."""
    counted = docs.select("text").filter("text is not null").mapInPandas(_pair_counts, "a string, b string, n bigint")
    return {(r.a, r.b): r.n for r in counted.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


def consistent_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, form): every text with its consistent form; a null text has a null form.

    First all texts are read for the letter-pair scores, then each token's lattice of look-alikes is searched. Forms of
    two texts are equal exactly if the texts are the same apart from full-width forms, composed or combining accents,
    invisible characters, kinds of blanks and look-alike letters. An empty table gives no rows; extra columns are left
    out; repeated rows stay.
    """
    pairs = letter_pairs(docs)
    kind = dict(docs.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(pairs)
        for frame in frames:
            frame["form"] = [None if t is None else lattice.text(t) for t in frame.text]
            yield frame

    return docs.select(F.col(key), "text").mapInPandas(run, f"`{key}` {kind}, text string, form string")


def lookalike_pairs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: texts that differ as stored but have the same consistent form.

    Only 128-bit digests are shuffled. Different stored texts of one form are paired first, each pair once, and only then
    met by their documents, so that copies of one stored text never meet each other. Null and blank texts and null keys
    have no pair.
    """
    forms = consistent_texts(docs.filter(F.col(key).isNotNull() & F.col("text").isNotNull()), key).filter(F.trim("form") != "")
    marks = cut(forms.select(F.col(key).alias("doc"), F.md5("form").alias("form"), F.md5("text").alias("stored")))
    texts = marks.select("form", "stored").distinct()
    a, b = texts.withColumnRenamed("stored", "sa"), texts.withColumnRenamed("stored", "sb")
    alike = a.join(b, "form").filter("sa < sb").select("sa", "sb")
    holders = marks.select("doc", "stored").distinct()
    x, y = holders.select(F.col("doc").alias("x"), F.col("stored").alias("sa")), holders.select(F.col("doc").alias("y"), F.col("stored").alias("sb"))
    return alike.join(x, "sa").join(y, "sb").filter("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
