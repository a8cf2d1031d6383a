"""Measures of rankings and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.order import running_sum


def recall_at(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: n_queries and recall_k, the share of queries with a true label among the first k. ranked: (qid, label,
    rk), truth: (qid, label); queries without any ranked label count as missed."""
    hits = truth.join(ranked, ["qid", "label"], "left").groupBy("qid").agg(F.min("rk").alias("at"))
    return hits.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(F.when(F.col("at") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks])


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: auc by rank sums with mean ranks for ties. label is 0 or 1. Counts per score are merged first; ranks
    are running sums over different scores, taken in ranges."""
    per = df.dropna(subset=[score, label]).groupBy(score).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"))
    ranked = running_sum(per, [score], "n", "upto").withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("m"))
    return total.select(F.when((F.col("p") > 0) & (F.col("m") > 0), F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("m")), 6)).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: average precision over falling scores, ties taken together."""
    per = df.dropna(subset=[score, label]).groupBy(score).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"))
    steps = per.withColumn("down", -F.col(score).cast("double"))
    steps = running_sum(running_sum(steps, ["down"], "p", "tp"), ["down"], "n", "all")
    return steps.agg(F.round(F.sum(F.col("tp") / F.col("all") * F.col("p")) / F.sum("p"), 6).alias("average_precision"))


def weighted_median(df: DataFrame, value: str, times: str) -> DataFrame:
    """One row: the median of values that occur ``times`` times each, the mean of the two in the middle if they are even;
    null without rows."""
    upto = running_sum(df.dropna(subset=[value, times]), [value], times, "upto")
    total = upto.agg(F.sum(times).alias("all"))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    held = lambda at: (F.col("upto") >= at) & (F.col("upto") - F.col(times) < at)
    both = upto.join(F.broadcast(total)).agg(F.max(F.when(held(low), F.col(value))).alias("a"), F.max(F.when(held(high), F.col(value))).alias("b"))  # one row
    return both.select(((F.col("a") + F.col("b")) / 2).alias("median"))
