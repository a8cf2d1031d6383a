"""Label transfer from ranked neighbours, its baselines and the pruning of weak labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.simjoin import nearest
from orrery.session import cut


def rank_within(df: DataFrame, group: str, *order: Column, name: str = "rk") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def transfer_labels(neighbours: DataFrame, labels: DataFrame, first: int = 20) -> DataFrame:
    """(qid, label, conf, support, vote, rk): the labels of the first neighbours (qid, rid, sim, rk); conf is the best
    similarity, support the number of neighbours, vote their sum; ranked by falling conf, support, vote, then label."""
    votes = neighbours.filter(F.col("rk") <= first).join(labels, "rid")
    scored = votes.groupBy("qid", "label").agg(F.max("sim").alias("conf"), F.count(F.lit(1)).alias("support"), F.round(F.sum("sim"), 6).alias("vote"))
    return rank_within(scored, "qid", F.col("conf").desc(), F.col("support").desc(), F.col("vote").desc(), F.col("label"))


def best_and_flags(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(qid, best, novel, exact) for every query: the best similarity (0 without neighbours), novel below 0.3, exact from 0.999."""
    best = neighbours.groupBy("qid").agg(F.max("sim").alias("best"))
    return queries.join(best, "qid", "left").select("qid", F.coalesce("best", F.lit(0.0)).alias("best")).withColumn("novel", F.col("best") < 0.3).withColumn("exact", F.col("best") >= 0.999)


def enrichment(neighbours: DataFrame, labels: DataFrame, n_rows: int) -> DataFrame:
    """(qid, label, score): the vote minus what the label's share of all rows would give."""
    votes = neighbours.join(labels, "rid").groupBy("qid", "label").agg(F.sum("sim").alias("vote"))
    totals = neighbours.groupBy("qid").agg(F.sum("sim").alias("total"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return votes.join(totals, "qid").join(sizes, "label").select("qid", "label", F.round(F.col("vote") - F.col("total") * F.col("n") / F.lit(n_rows), 6).alias("score"))


def set_zscore(raw: DataFrame, labels: DataFrame, mean: float, square: float) -> DataFrame:
    """(qid, label, z): (raw - n * mean) / sqrt(n * variance). raw: (qid, label, raw), the sums of similarities over all
    rows of a label; mean and square: of one pair's share, those that give nothing included."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    spread = F.sqrt(F.col("n") * F.lit(max(square - mean * mean, 1e-12)))
    return raw.select("qid", "label", "raw").join(sizes, "label").select("qid", "label", F.round((F.col("raw") - F.col("n") * F.lit(mean)) / spread, 6).alias("z"))


def drop_weak(predicted: DataFrame, floor: float = 0.4, most: int = 50) -> DataFrame:
    """(qid, label, conf, support, rk): without labels of a single support under ``floor``, at most ``most`` per query."""
    strong = predicted.filter(~((F.col("support") == 1) & (F.col("conf") < floor)))
    return rank_within(strong, "qid", F.col("conf").desc(), F.col("label")).filter(F.col("rk") <= most)


def naive_bayes(training: DataFrame, queries: DataFrame, k: int, alpha: float = 1.0, bits: int = 2048) -> DataFrame:
    """(qid, label, score, rk): for each query (qid, fp) the k labels of the highest sum over its set bits of
    ln((c + alpha) / (n + 2 alpha)), c of n training rows (rid, label, bit) of the label having the bit, ties to the smaller
    label; labels none of whose rows has a bit of the query are left out.

    Each label becomes one vector of its weights; blocks of queries meet blocks of labels in matrix products, so neither
    queries nor bits are multiplied with labels in rows.
    """
    sizes = training.groupBy("label").agg(F.countDistinct("rid").alias("n"))
    counts = training.groupBy("label", "bit").agg(F.count(F.lit(1)).alias("c"))
    held = counts.groupBy("label").agg(F.collect_list("bit").alias("bits"), F.collect_list("c").alias("counts")).join(sizes, "label")  # at most ``bits`` entries
    kind = dict(training.dtypes)["label"]

    def weights(batches):
        for batch in batches:
            m = np.empty((batch.num_rows, bits))
            for i, (at, c, n) in enumerate(zip(batch.column("bits"), batch.column("counts"), batch.column("n").to_numpy())):
                m[i] = np.log(alpha / (n + 2 * alpha))
                m[i, at.values.to_numpy()] = np.log((c.values.to_numpy() + alpha) / (n + 2 * alpha))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * bits), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists], ["label", "w"])

    labels = cut(held.mapInArrow(weights, f"label {kind}, w array<double>"))  # counted, then met
    near = nearest(queries, labels, k, floor=-1e300, measure="bayes", digits=6)
    return near.select("qid", F.col("rid").alias("label"), F.col("sim").alias("score"), "rk")
