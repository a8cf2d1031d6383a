"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import cut


def connected_components(links: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); a component is named by its smallest node.

    Large-star and small-star steps alternate until the links are stars; each round is a grouped minimum and a join on
    the node, and its result goes to the checkpoint folder. No step gathers a component: a neighbourhood is reduced to
    its minimum with map-side combining. Links to itself or with a null end carry nothing; no links give no rows.
    """
    # a table of links is told from another by its size and two independent xors over its rows
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
    edges = cut(links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(edges)
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is tied to the smallest of its closed neighbourhood
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = cut(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        nxt = cut(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        edges, before, seen = nxt, seen, mark(nxt)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
