import pytest
from pyspark.sql import functions as F

from orrery.engine import Collection, Engine
from orrery.session import table


@pytest.fixture(scope="module")
def engine(spark, data):
    ligands = table(spark, data, "chembl").filter("fp is not null").select(F.col("cid").alias("id"), F.col("fp").alias("vector"), "popcount")
    vectors = table(spark, data, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    labels = ligands.select(F.col("id").alias("rid"), F.concat(F.lit("P"), (F.col("id") % 5).cast("string")).alias("label"))
    targets = spark.createDataFrame([(f"P{i}", f"G{i}", f"name {i}", "Homo sapiens (Human)" if i else "Mus musculus") for i in range(5)], "label string, gene string, name string, org string")
    return Engine(spark, {"ligands": Collection(ligands, "chemical"), "texts": Collection(vectors, "text", 64)}, labels, targets)


def test_modes(engine):
    assert {r.name: r.dim for r in engine.collections().collect()} == {"ligands": 2048, "texts": 64}
    assert engine.query("texts", ids=["3", 4]).count() == 2
    hits = engine.query("texts", like=7, filter={"label": [1, 2, 3]}, limit=5).collect()
    assert len(hits) == 5 and all(r.label in (1, 2, 3) for r in hits) and [r.score for r in hits] == sorted((r.score for r in hits), reverse=True)
    assert engine.query("texts", like=7, limit=1).first().id == 7
    assert [r.id for r in engine.query("texts", like=7, limit=2, offset=1).collect()] == [r.id for r in engine.query("texts", like=7, limit=3).collect()][1:]
    assert [r.id for r in engine.query("texts", after=10, limit=3).collect()] == [11, 12, 13]
    assert engine.query("texts", limit=10_000).count() == 100 and engine.query("texts", limit=0).count() == 1
    assert engine.count("texts", filter={"label": {"gte": 2, "lte": 3}}) == engine.count("texts", filter={"label": [2, 3]})
    assert 7 not in [r.id for r in engine.similar("texts", id=7, limit=5, labels=None).collect()]


def test_predict_self(engine):
    row = engine._all["ligands"].rows.filter("id % 5 <> 0").orderBy("id").first()
    best = engine.predict("ligands", vector=row.vector).first()
    assert best.conf == 1.0 and best.band == "HIGH" and engine.known_labels(id=row.id) == [f"P{row.id % 5}"]
    assert "P0" not in [r.label for r in engine.predict("ligands", vector=row.vector).collect()]


def test_known_labels_stay_below_the_floor(engine):
    row = engine._all["ligands"].rows.filter("id % 5 <> 0").orderBy("id").first()
    every = engine.predict("ligands", vector=row.vector, top=100).collect()
    last = every[-1]
    out = {r.label: r.known for r in engine.predict("ligands", vector=row.vector, floor=1.0, known=[last.label]).collect()}
    assert out[last.label] is True and all(k or r.conf >= 1.0 for r in every if r.label in out for k in [out[r.label]])


def test_names(spark, engine):
    names = spark.createDataFrame([("AAAAAAAAAAAAAA-X", "whole"), ("AAAAAAAAAAAAAA-B", "first"), ("CCCCCCCCCCCCCC-C", "part"), ("DDDDDDDDDDDDDD", None)], "key string, name string")
    e = Engine(spark, {}, names=names)
    assert e.name(key="AAAAAAAAAAAAAA-X") == "whole" and e.name(key="AAAAAAAAAAAAAA-Z") == "first"
    assert e.name(key="ZZZ", parts=["DDDDDDDDDDDDDD", "CCCCCCCCCCCCCC-Q"]) == "part" and e.name(key="ZZZ") is None
    with pytest.raises(ValueError):
        engine.name(key="x")


def test_errors(engine):
    for bad in (lambda: engine.query("none"), lambda: engine.query("texts", text="x"), lambda: engine.query("texts", like=-1), lambda: engine.count("texts", filter={"nope": 1}), lambda: engine.count("texts", filter={"label": {"near": 1}})):
        with pytest.raises(ValueError):
            bad()
