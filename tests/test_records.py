"""Record expressions and state helpers on awkward values."""

import datetime

from pyspark.sql import functions as F

from orrery.functions import records as R
from orrery.functions.text import canonical_assignee
from orrery.operators import state
from orrery.operators.evaluate import weighted_median
from orrery.operators.order import first_occurrences
from orrery.operators.provenance import contiguous_groups, span
from orrery.operators.simjoin import ranks_of


def one(spark, values, kind, expression):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_texts_and_numbers(spark):
    assert one(spark, ["CCO", "[H]C([2H])Cl", "c1ccccc1Br", "", None], "string", R.heavy_atoms) == [3, 2, 7, 0, None]
    assert one(spark, ["SCHEMBL12", "SCHEMBL", "12", "SCHEMBL1x", "SCHEMBL" + "9" * 30, None], "string", R.numbered) == [12, None, None, None, None, None]
    assert one(spark, ["123.0", "7", "-1.9", "nan", "x", "", None], "string", R.whole_number)[:3] == [123, 7, -2]
    assert one(spark, ["123.0", "7", "nan", "a.0b", None], "string", R.plain_number_text) == ["123", "7", "", "a.0b", ""]
    assert one(spark, ["I20240131-r1.zip", "x20241399", "no", None], "string", R.compact_date) == [datetime.date(2024, 1, 31), None, None, None]
    assert one(spark, ['{"a":"20240131","b":[{"c":"19991231"},{"d":"20240131"}],"n":"20249999"}', "{}", None], "string", R.all_dates) == [[datetime.date(1999, 12, 31), datetime.date(2024, 1, 31)], [], None]
    assert one(spark, [["a", "b", "c", "d"], ["x" * 3000], [], None], "array<string>", R.first_claims) == ["a b c", "x" * 2000 + "...", "", None]
    paths = [["x/Enzyme/Hydrolase", "x/Ion channel"], ["x/Adhesion"], ["x/Unclassified protein"], [], None]
    assert one(spark, paths, "array<string>", lambda c: R.family_name(R.family_place(c))) == ["Ion channel", R.CLASSIFIED, *[R.UNCLASSIFIED] * 3]


def test_small_vectors(spark):
    assert one(spark, ["ab", "", None], "string", lambda c: R.word_vector(c, 4))[1:] == [[0.0] * 4] * 2
    got = one(spark, [[[9.0, 9.0], [1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [[1.0, 1.0]], [], None], "array<array<double>>", lambda c: R.mean_pool(c, 2))
    assert got == [[2.0, 3.0], None, None, None]
    v = one(spark, ["abab", "zz", ""], "string", lambda c: R.kmer_counts(c, "ab"))
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and v[1] == [0.0] * 6 and v[2] == [0.0] * 6
    df = spark.createDataFrame([("g", 1000.0), ("g", 1000.0), ("h", None)], "k string, x double")
    assert {r.k: r.y for r in df.groupBy("k").agg(F.round(R.log_sum_exp(F.col("x")), 6).alias("y")).collect()}["g"] == 1000.693147


def test_assignees(spark):
    names = ["AMIRA PHARMACEUTICALS, INC. (US)", "Amira Phamaceuticals Ltd.", "E.I. du Pont de Nemours and Company", "Smith & Nephew KGaA", "O'Brien-Müller GmbH & Co. KG", "Inc", "", None]
    want = ["Amira Pharmaceuticals", "Amira Pharmaceuticals", "Du Pont", "Smith And Nephew", "O'Brien Müller", "", "", ""]
    assert one(spark, names, "string", canonical_assignee) == want


def test_replaced_added_and_deleted(spark):
    base = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    patch = spark.createDataFrame([("a", 9), ("c", 5)], "k string, v int")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(state.replace_documents(base, patch, "k")) == sorted([("a", 9), ("b", 3), ("c", 5), (None, 4)], key=str)
    assert rows(state.add_only(base, patch, ["k"])) == sorted([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], key=str)
    assert rows(state.without_deleted(base, patch, "k")) == sorted([("b", 3), (None, 4)], key=str)
    assert state.replace_documents(base.limit(0), patch.limit(0), "k").count() == 0


def test_cache_remembers_misses_but_no_errors(spark):
    schema = "key string, status string, payload string"
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,), ("d",)], "key string")
    fetched = spark.createDataFrame([("a", "hit", "A"), ("b", "miss", None), ("c", "error", "half")], schema)
    answers, cache = state.read_through(spark.createDataFrame([("d", "miss", None)], schema), wanted, fetched)
    assert {tuple(r) for r in answers.collect()} == {("a", "hit", "A"), ("b", "miss", None), ("c", "error", None), ("d", "miss", None)}
    assert {tuple(r) for r in cache.collect()} == {("a", "hit", "A"), ("b", "miss", None), ("d", "miss", None)}


def test_orders(spark):
    df = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "b", 3), ("q", None, 4), ("r", "a", 1)], "q string, x string, rk int")
    assert {tuple(r) for r in first_occurrences(df, "q", F.col("x"), "rk").collect()} == {("q", "b", 1), ("q", "a", 2), ("r", "a", 1)}
    assert {tuple(r) for r in first_occurrences(df, "q", F.col("x"), "rk", 1).collect()} == {("q", "b", 1), ("r", "a", 1)}
    values = spark.createDataFrame([(1.0, 2), (5.0, 1), (7.0, 1), (None, 9)], "v double, m int")
    assert weighted_median(values, "v", "m").first().median == 3.0 and weighted_median(values.limit(0), "v", "m").first().median is None


def test_groups_streamed_in_order(spark):
    rows = [("hot", datetime.date(2000, 1, 1) + datetime.timedelta(days=i % 300)) for i in range(3000)] + [("a", None), ("b", datetime.date(1999, 1, 1)), (None, None)]
    out = {r.g: (r.n, r["first"], r["last"]) for r in contiguous_groups(spark.createDataFrame(rows, "g string, d date").repartition(7), "g", "d").collect()}
    assert out == {"hot": (3000, datetime.date(2000, 1, 1), datetime.date(2000, 10, 26)), "a": (1, None, None), "b": (1, datetime.date(1999, 1, 1), datetime.date(1999, 1, 1))}


def test_span_of_small_groups(spark):
    rows = [("g", i, f"t{i}") for i in range(3)] + [("h", i % 4, f"t{i:02d}") for i in range(20)]
    out = sorted(tuple(r) for r in span(spark.createDataFrame(rows, "g string, d int, t string"), "g", "d", "t", 4).collect())
    assert out == [("g", 0, "t0"), ("g", 1, "t1"), ("g", 2, "t2"), ("h", 0, "t00"), ("h", 0, "t04"), ("h", 3, "t15"), ("h", 3, "t19")]


def test_ranks_in_blocks(spark):
    q = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "id int, v array<double>")
    r = spark.createDataFrame([(f"r{i:02d}", [float(i % 5), float(i % 2)], float(i % 3)) for i in range(30)], "id string, v array<double>, b double")
    ask = [(i, f"r{j:02d}") for i in range(9) for j in (0, 7, 29)] + [(99, "r00"), (1, "none")]
    got = {(x.qid, x.label): x["rank"] for x in ranks_of(q, r, spark.createDataFrame(ask, "q int, r string"), "dot", 6, "b", block=4).collect()}
    want = {}
    for i in range(9):
        order = sorted(range(30), key=lambda j: (-((i % 3) * (j % 5) + j % 2 - j % 3), f"r{j:02d}"))
        want |= {(i, f"r{j:02d}"): order.index(j) + 1 for j in (0, 7, 29)}
    assert got == want
