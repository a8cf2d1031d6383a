import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orrery.llm.components import connected_components
from orrery.llm.names import name_entities, parse_name, same_entity_pairs, similar_keys


@pytest.mark.parametrize("a, b", [
    ("University of Ralizil Nesadrin", "Ralizil-Nesadrin Univ. (URN)"), ("Kedibem Nomivak Therapeutics Ltd.", "KEDIBEM NOMIVAK TX, INC. [DE]"), ("Fanigol Breveben Chemicals International S. A.", "fanigolbreveben chem. int'l"),
    ("Medical Center, Rodrigar Medrefek", "RodrigarMedrefek Medicalcenter"), ("Nisokem Rasozeth U. Hosp.", "Nisokem Rasozeth University Hospital"), ("Tapekek and Sobemom Laboratories", "Tapekek & Sobemom Lab. Co., Ltd."),
    ("Dr. William F Femosetothge", "Femosetothge, Bill F."), ("FEMOSETOTHGE WILLIAM", "William Femosetothge"), ("O'Brien, Tom", "Thomas OBrien"), ("S. A. Nilelitemli", "Nilelitemli SA"),
])
def test_parsed_alike(a, b):
    x, y = parse_name(a), parse_name(b)
    assert x[0] == y[0] and set(x[1]) & set(y[1]) and x[2] == y[2]


@pytest.mark.parametrize("a, b", [("Semamis Dadrinen Diagnostics Inc.", "Semamis Dadrinen Therapeutics Inc."), ("Bibrenar Dabrenol Foundation", "University of Bibrenar Dabrenol"), ("Michael Dizemeranva", "Alexander Dizemeranva")])
def test_parsed_apart(a, b):
    x, y = parse_name(a), parse_name(b)
    assert (x[0], x[2]) != (y[0], y[2])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab", min_size=3, max_size=11), min_size=2, max_size=25, unique=True))
def test_segment_join_loses_nothing(spark, keys):
    got = {frozenset((r.a, r.b)) for r in similar_keys(spark.createDataFrame([("d", k) for k in keys], "domain string, key string")).collect()}
    least = lambda p: min(map(len, p))
    swapped = lambda a, b: sorted(a) == sorted(b) and distance(a, b) == 2
    assert got == {frozenset(p) for p in itertools.combinations(keys, 2) if distance(*p) <= (2 if least(p) >= 9 else 1 if least(p) >= 6 else 0) or (least(p) < 9 and swapped(*p))}


def test_components(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "a")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert [out[k] for k in "abcdxy"] == ["a"] * 4 + ["x"] * 2 and "z" not in out and {out[f"n{i:03d}"] for i in range(61)} == {"n000"}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def groups(spark, names):
    by = {}
    for r in name_entities(spark.createDataFrame([(n, 1) for n in names], "name string, entity int")).collect():
        by.setdefault(r.entity, set()).add(r.name)
    return sorted(map(sorted, by.values()))


def test_entities(spark):
    one = ["University of Ralizil Nesadrin (URN)", "Univ. of Rlaizil Nesadrin", "ralizilnesadrin university", "URN"]
    two = ["Ralizil Nesadrin Foundation"]
    ann = ["Michael E. Bekeladremdi", "Mike Bekeladremdi", "M. E. Bekeladremdi"]
    bob = ["Margaret Bekelaadremdi", "BEKELADREMDI MARGARET"]
    lone = ["Bekeladremdi XY", "ABC"]
    assert groups(spark, [*one, *two, *ann, *bob, *lone, one[0], None, "", "  ", "...", "x" * 20_000]) == sorted([sorted(one), two, sorted(ann), sorted(bob), *[[x] for x in lone], ["x" * 20_000]])
    assert groups(spark, []) == []


def test_ambiguous_initials_stay_alone(spark):
    assert groups(spark, ["Michael Bekeladremdi", "Margaret Bekeladremdi", "Bekeladremdi MK"]) == [["Bekeladremdi MK"], ["Margaret Bekeladremdi"], ["Michael Bekeladremdi"]]


PROBES = [
    ["Chen, Wei", "Wei Chen"], ["Cheng, Wei"], ["Chang, Wei"], ["Zhang, Wei"], ["Merck Inc", "Merck GmbH"], ["Merch Inc"], ["Kyoto University", "Univ. of Kyoto"], ["Kyodo University"],
    ["Bauer AG", "Bauer GmbH"], ["Bayer AG", "BAYER A.G."], ["Bayern AG"], ["Jonathan Smithson", "Jonathon Smithson", "Smithson, Jonathan"], ["Stanford Universtiy", "Stanford University"],
    ["Acme Rocket Motors Europe", "Acme Rocket Motosr Europe"], ["Hoffmannsthal NV", "N. V. Hoffmannsthal"], ["Deutsche Kraftwerke Nordsee AG", "DEUTSCHE KRAFTWERKE NORDSEE GmbH"], ["Bio-Sciences Ostermoor", "Ostermoor Biosciences"],
]


def test_typed_by_hand(spark):
    assert groups(spark, [n for g in PROBES for n in g]) == sorted(map(sorted, PROBES))


def test_given_names_of_their_own_are_no_misspellings(spark):
    names = ["Christina Bekeladremdi", "Christine Bekeladremdi", "Christina Ostermoor", "Christine Ostermoor"]
    assert groups(spark, names) == [[n] for n in sorted(names)]


def test_hot_entity(spark):
    e = spark.createDataFrame([(f"n{i:03d}", 1) for i in range(90)] + [("x", 2)], "name string, entity int")
    out = [tuple(r) for r in same_entity_pairs(e, piece=8).collect()]
    assert len(out) == len(set(out)) == 90 * 89 // 2 and all(a < b for a, b in out)


def test_pairs(spark):
    e = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1), ("d", 2)], "name string, entity int")
    assert sorted(tuple(r) for r in same_entity_pairs(e).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
