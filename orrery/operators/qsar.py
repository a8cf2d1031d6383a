"""A classifier on fingerprints with whole groups held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.evaluate import average_precision, roc_auc

LEAST_ROWS, LEAST_SHARE = 200, 0.05


def fit_and_score(df: DataFrame, words: int = 32, held_out: float = 0.2, rounds: int = 20, kind: str = "logistic", save: str | None = None) -> DataFrame:
    """One row (n_train, n_test, share, auc, average_precision) for (id, fp, grp, label 0 or 1).

    Groups go to the held-out part by the hash of their name, so that no group stands on both sides. Fewer than 200 rows,
    a single class, or no held-out rows raise ValueError. share is that of label 1; under 5 % the measures say little. kind
    is 'logistic' or 'forest'. The model and its measures are kept under ``save``, if given; ``load_model`` reads them.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    bits = F.flatten(F.transform("fp", lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", w, b).cast("double"))))
    # the vector function fails on a null even in rows that the filter drops, if it is run before it
    bits = F.coalesce(bits, F.array_repeat(F.lit(0.0), 64 * words))
    rows = df.filter((F.size("fp") == words) & F.col("label").isNotNull())
    n, share = rows.agg(F.count(F.lit(1)), F.avg("label")).first()
    if n < LEAST_ROWS or not 0 < share < 1:
        raise ValueError(f"{n} rows with a share of {share} cannot be fitted")
    side = (F.pmod(F.xxhash64("grp"), F.lit(1000)) < int(1000 * held_out)).alias("held")
    data = rows.select("id", "label", side, array_to_vector(bits).alias("features"))
    train, test = data.filter("not held"), data.filter("held")
    n_test = test.count()
    if not n_test:
        raise ValueError("no group is held out")
    models = {"logistic": LogisticRegression(maxIter=rounds, regParam=0.01), "forest": RandomForestClassifier(numTrees=rounds, maxDepth=8, seed=7)}
    model = models[kind].fit(train)
    scored = model.transform(test).select("label", vector_to_array("probability")[1].alias("score"))
    auc, ap = roc_auc(scored, "score", "label"), average_precision(scored, "score", "label")
    head = df.sparkSession.createDataFrame([(n - n_test, n_test, float(share))], "n_train bigint, n_test bigint, share double")
    out = head.join(F.broadcast(auc)).join(F.broadcast(ap))  # one row each
    if save:
        model.write().overwrite().save(f"{save}/model")
        out.withColumn("kind", F.lit(kind)).write.mode("overwrite").json(f"{save}/measures")
    return out


def load_model(spark, path: str):
    """(model, its measures as a row) of what ``fit_and_score`` kept."""
    from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel

    measures = spark.read.json(f"{path}/measures").first()
    kinds = {"logistic": LogisticRegressionModel, "forest": RandomForestClassificationModel}
    return kinds[measures.kind].load(f"{path}/model"), measures
