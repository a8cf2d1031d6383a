import pytest

from orrery.operators.qsar import fit_and_score

SCHEMA = "id bigint, fp array<bigint>, grp string, label double"


def rows(n):
    return [(i, [(i * 2654435761) % 2**40 | (1 << 50 if i % 3 == 0 else 0)] + [0] * 31, f"g{i % 40}", 1.0 if i % 3 == 0 else 0.0) for i in range(n)]


def test_learns_a_bit(spark):
    out = fit_and_score(spark.createDataFrame(rows(400) + [(999, None, None, 1.0), (998, [1], "x", None)], SCHEMA)).first()
    assert out.auc > 0.99 and out.average_precision > 0.99 and out.n_train + out.n_test == 400


def test_refuses(spark):
    for bad in (rows(50), [(i, f, g, 1.0) for i, f, g, _y in rows(300)]):
        with pytest.raises(ValueError):
            fit_and_score(spark.createDataFrame(bad, SCHEMA))


def test_forest_is_kept_and_read(spark, tmp_path):
    from orrery.operators.qsar import load_model

    many = [(i, [f[0], *[-1 if y else 0] * 31], g, y) for i, f, g, y in rows(400)]  # a forest looks at few bits at a time
    out = fit_and_score(spark.createDataFrame(many, SCHEMA), kind="forest", save=str(tmp_path)).first()
    model, measures = load_model(spark, str(tmp_path))
    assert out.auc > 0.9 and abs(measures.auc - out.auc) < 1e-9 and model.getNumTrees == 20
