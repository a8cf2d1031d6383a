"""Splitting, look-alike forms and leak search."""

import re
import unicodedata

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orrery.llm.leaks import SLACK, ItemIndex, leaked_items, words_of
from orrery.llm.lookalike import MEMBERS, SKELETON, Lattice, consistent_texts, letter_pairs, lookalike_pairs, skeleton
from orrery.llm.split import split_spans, split_texts


@settings(max_examples=400, deadline=None)
@given(st.text("aab. \n!", max_size=300), st.integers(5, 40), st.data())
def test_pieces(text, limit, data):
    overlap = data.draw(st.integers(0, limit // 2))
    spans = split_spans(text, limit, overlap)
    held = set()
    for a, b, _how in spans:
        assert 0 <= a < b <= len(text) and b - a <= limit
        held |= set(range(a, b))
    assert all(text[i].isspace() for i in set(range(len(text))) - held)
    for (a, b, how), (c, e, _h) in zip(spans, spans[1:]):
        assert a < c and b < e and b - c <= overlap
        if how != "hard":
            assert text[b - 1 : b].strip() and (b == len(text) or text[b].isspace())
    longest = max(map(len, re.findall(r"\S+", text)), default=0)
    if len(text) > limit:
        assert any(h == "hard" for *_x, h in spans) == (longest > limit)


def test_boundaries():
    text = "One two three. Four five six.\n\nSeven eight nine ten. Eleven twelve"
    spans = split_spans(text, 40, 8)
    assert [(text[a:b], how) for a, b, how in spans][0] == ("One two three. Four five six.", "paragraph")
    assert split_spans("short", 40, 8) == [(0, 5, "end")] and split_spans("", 4, 1) == []
    with pytest.raises(ValueError):
        split_spans("x", 4, 4)


def test_split_table(spark):
    df = spark.createDataFrame([("a", "x " * 50, 1), ("b", None, 2), ("c", "", 3), ("d", "y" * 200_000, 4), ("a", "x " * 50, 1)], "k string, t string, piece int")
    out = split_texts(df, ["k"], "t", 60, 10).collect()
    assert {r.k for r in out} == {"a", "d"} and all(len(r.text) <= 60 for r in out) and sum(r.k == "a" and r.piece == 0 for r in out) == 2
    assert split_texts(df.limit(0), ["k"], "t", 60, 10).count() == 0


def disguised(text, data):
    out = []
    for c in text:
        options = list("".join(MEMBERS[SKELETON[ord(c)]])) if ord(c) in SKELETON else [c]
        options = [x for x in options if x not in "Ӏӏ"]
        c = data.draw(st.sampled_from(options))
        if "!" <= c <= "~" and data.draw(st.booleans()):
            c = chr(ord(c) + 0xFEE0)
        if c == " ":
            c = data.draw(st.sampled_from([" ", " ", " ", "　"]))
        out.append(c + data.draw(st.sampled_from(["", "", "​", "­"])))
    joined = "".join(out)
    return data.draw(st.sampled_from([joined, unicodedata.normalize("NFD", joined)]))


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["Dosing began at 5.8 µM, rôle naïve", "После отмены состояние больных", "a cope xo y", "La señal y él", "TM ΑΒΓ x²"]), st.data())
def test_disguises_fall_together(text, data):
    lattice = Lattice({("^", "a"): 5, ("c", "o"): 3, ("^", "у"): 900})
    assert lattice.text(disguised(text, data)) == lattice.text(text)


@pytest.mark.parametrize("a, b", [("Cope", "cope"), ("naïve", "naive"), ("x²", "x2"), ("α cell", "a cell"), ("a\nb", "a b"), ("rn", "m")])
def test_visible_differences_stay(a, b):
    assert Lattice().text(a) != Lattice().text(b)


@pytest.mark.parametrize("pair", ["νv", "υu", "ιi", "χx", "ρp", "ԁd", "ҮY", "УY", "օo", "ոn", "ՏS", "һh", "ԛq", "ѵv", "ՍU", "հh"])
def test_letters_of_one_shape(pair):
    assert Lattice().text(f"spe{pair[0]}trum") == Lattice().text(f"spe{pair[1]}trum") and Lattice().text(pair[0]) == Lattice().text(pair[1])


def test_the_lattice_decides_between_readings():
    """The same typed letter equals I in one word and l in another, by what other texts have."""
    pairs = {("^", "I"): 50, ("I", "n"): 50, ("a", "l"): 90, ("l", "l"): 40, ("^", "a"): 90}
    assert Lattice(pairs).text("Ӏn aӏӏ") == "In all"
    assert Lattice({("^", "l"): 50, ("l", "n"): 50}).text("Ӏn") == "ln"


def test_pairs_over_copies(spark):
    rows = [(i, "The rôle of it") for i in range(400)] + [(1000, "Тhе rôle of it"), (1001, "Ｔhe rôle of it")]
    out = {tuple(r) for r in lookalike_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {(i, d) for i in range(400) for d in (1000, 1001)} | {(1000, 1001)}


def test_letter_pairs(spark):
    df = spark.createDataFrame([("he H́e",), ("нет",), (None,), ("cop 漢字he",), ("",)], "text string")
    assert letter_pairs(df) == {("^", "н"): 1, ("н", "е"): 1, ("е", "т"): 1}
    assert letter_pairs(spark.createDataFrame([("the β-rest réal",)], "text string"))["t", "h"] == 1


def test_forms_are_readable():
    lattice = Lattice({("^", "у"): 10_000})
    assert lattice.text("Incluyó 859 niños y 896 adultos") == "Incluyó 859 niños y 896 adultos"
    assert lattice.text("у 896 больных, cостав") == "у 896 больных, состав" and lattice.text("Сomраred wіth") == "Compared with"
    assert skeleton("Ｔһе") == "The"


def test_pairs(spark):
    rows = [(1, "The rôle of it", "x"), (2, "Тhе rôle of it", "y"), (3, "The rôle of it", None), (4, "The role of it", None), (5, None, None), (6, " ", None), (7, " ", None), (None, "Тhе rôle of it", None), (2, "Тhе rôle of it", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    assert sorted(tuple(r) for r in lookalike_pairs(df).collect()) == [(1, 2), (2, 3)]
    assert consistent_texts(df).count() == len(rows) and lookalike_pairs(df.limit(0)).count() == 0


WORDS = [f"w{i}" for i in range(12)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=3, max_size=9), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from(WORDS), max_size=80), min_size=1, max_size=8))
def test_leaks_equal_brute_force(spark, items, docs):
    run = 4
    grams = lambda w: {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    want = {(d, i) for d, w in enumerate(docs) for i, p in enumerate(items) if grams(w) & grams(p)}
    dd = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id bigint, text string")
    ii = spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in enumerate(items)], "item_id bigint, passage string")
    assert {tuple(r) for r in leaked_items(dd, ii, run, window=9, items_at_once=3).collect()} == want


def test_wand_finds_what_scoring_all_finds():
    r = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(300)])
    odds = 1 / np.arange(1, 301)
    items = [(i, " ".join(r.choice(words, r.integers(8, 40), p=odds / odds.sum()))) for i in range(200)]
    index = ItemIndex(items, run=6, block=8)
    assert index.nbytes() < 40 * len(index.keys) + 8 * 40 * 200
    dense = np.zeros((index.none + 1, index.n), np.float32)
    dense[index.keys // index.n, index.keys % index.n] = index.weights
    terms = np.full((150, 14), index.none)
    for row in terms:
        own = np.unique(r.integers(0, index.none, r.integers(1, 15)))
        row[: len(own)] = own
    p, i = index.candidates(terms)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(dense[terms].sum(1) >= SLACK))}
    assert len(want) > 100 and sorted(zip(p.tolist(), i.tolist())) == sorted(want)
    empty = ItemIndex([])
    assert len(empty.candidates(np.full((3, 4), empty.none))[0]) == 0


def test_leaks_awkward(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, "x " * 5000 + "One, two thrеe­four".replace("­", " ") + " " + passage[19:].upper()), (2, None), (None, passage), (3, ""), (4, passage[:-20]), (1, passage)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (None, passage), (3, "too short")], "item_id bigint, passage string")
    assert [tuple(r) for r in leaked_items(docs, items).collect()] == [(1, 1)]
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0
    assert words_of("Naïve-β2 Ｔest_x") == ["naïve", "β2", "test", "x"]
