"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def token_counts(docs: DataFrame, key: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, source, n_tokens): tokens of every whole text in the public vocabulary at ``vocabulary``, a path that every
    executor can read. Null texts have 0."""
    kind = dict(docs.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "source": frame["source"], "n_tokens": [0 if t is None else len(encoding.encode_ordinary(t)) for t in frame["text"]]})

    return docs.select(key, "source", "text").mapInPandas(run, f"`{key}` {kind}, source string, n_tokens bigint")


def virtual_horizon(totals: list[tuple[float, int, int]], budget: int | None) -> float:
    """The virtual time at which the queue stops. totals: (share, most tokens, tokens once) of each source with tokens.
    budget None: the last time at which no source has run dry; else the time at which the budget is used, sources that
    ran dry giving no more (infinite if all run dry first)."""
    live = sorted((most / share, share, most) for share, most, _once in totals)
    if not live:
        return 0.0
    if budget is None:
        return live[0][0]
    spent, weight = 0.0, sum(s for _t, s, _m in live)
    for time, share, most in live:
        if spent + weight * time >= budget:
            return (budget - spent) / weight
        spent += most
        weight -= share
    return float("inf")


def shuffle_hash(seed: int, key: Column) -> Column:
    """60 bits that order documents at random but reproducibly."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def _listed(shares: DataFrame) -> DataFrame:
    return shares.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").filter("source is not null").dropDuplicates(["source"])


def mix_sized(sized: DataFrame, shares: DataFrame, budget: int | None = None, seed: int = 7, rows_at_once: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). sized: (doc_id, source, n_tokens); shares: (source, target_share, max_repeats).

    Each source's documents are shuffled by a seeded hash and queued once per permitted repeat; a copy's virtual finish
    time is the source's tokens up to and with it, divided by the target share. All queued copies are range-sorted by
    that time and cut where ``budget`` tokens are full (None: where the first source with tokens has no more to give). Copies
    that finish later than the time at which the budget must be full, which follows from the sources' totals, are not made.
    Prefix sums, of a source and of the whole sorted queue, are taken in two steps: over ranges of about ``rows_at_once``
    documents resp. one partition, then over their totals; so a source with a third of all rows is spread over many tasks.

    mixture: doc_id, copy_no, source, n_tokens, finish, in order. report: one row per listed source with target_share,
    the share among the sources that have tokens, tokens, actual_share, docs, most_copies. Sources are compared trimmed
    and in lower case; documents of unlisted or null source, of null id or without tokens are not used; rows of one
    doc_id count as one document. Listed sources without documents give 0 and are reported; shares of 0 or null give
    nothing. The list of sources is collected (it is a configuration); no documents: an empty mixture.
    """
    listed = _listed(shares)
    usable = sized.select("doc_id", F.lower(F.trim("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")).filter("doc_id is not null and n_tokens > 0")
    usable = usable.join(F.broadcast(listed.select("source")), "source").groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens")).alias("x"))
    docs = cut(usable.select("doc_id", "x.source", "x.n_tokens", shuffle_hash(seed, F.col("doc_id")).alias("h")))
    bits = max(4, (docs.count() // rows_at_once).bit_length())
    docs = docs.withColumn("bucket", F.shiftright("h", 60 - bits))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")) - F.col("tokens")
    totals = sums.groupBy("source").agg(F.sum("tokens").alias("once"), F.max("longest").alias("longest"))
    queue = sums.select("source", "bucket", before.alias("before")).join(totals, "source").join(listed, "source")
    live = listed.join(totals, "source").filter("target_share > 0 and max_repeats > 0").collect()
    horizon = virtual_horizon([(r.target_share, r.once * r.max_repeats, r.once) for r in live], budget)
    within = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id"))
    queued = docs.withColumn("upto", within).join(queue, ["source", "bucket"]).withColumn("upto", F.col("upto") + F.col("before")).filter("target_share > 0")
    # so many copies finish by then; the budget is full at the latest when each source's copy at the horizon is out
    last = horizon if budget is None else horizon + max((r.longest / r.target_share for r in live), default=0.0)
    room = F.lit(last) * F.col("target_share") * (1 + 1e-12)
    copies = F.floor(F.least((room - F.col("upto")) / F.col("once") + 1, F.col("max_repeats").cast("double"))).cast("int")
    made = queued.withColumn("copies", copies).filter("copies >= 1").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    mixture = made.select("doc_id", "copy_no", "source", "n_tokens", ((F.col("upto") + (F.col("copy_no") - 1) * F.col("once")) / F.col("target_share")).alias("finish"))
    order = ["finish", "source", "doc_id", "copy_no"]
    if budget is not None:
        ranged = cut(mixture.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
        parts = ranged.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))  # one row a partition
        offsets = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
        filled = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
        mixture = ranged.join(F.broadcast(offsets), "part").withColumn("filled", filled).filter(F.col("filled") <= budget).drop("part", "before", "filled")
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("docs"), F.max("copy_no").alias("most_copies"))
    alive = sum(r.target_share for r in live)
    total = used.agg(F.sum("tokens").alias("all_tokens"))
    report = (
        listed.join(used, "source", "left").join(F.broadcast(total))  # one row
        .select("source", "target_share", F.when(F.col("tokens").isNotNull() & F.lit(alive > 0), F.col("target_share") / F.lit(alive or 1.0)).alias("reachable_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
                F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    )
    return mixture.orderBy(*order), report


def mix_sources(docs: DataFrame, shares: DataFrame, budget: int | None = None, vocabulary: str = VOCABULARY, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``mix_sized`` of documents (doc_id, text, source), sized by their tokens. Only documents of listed sources are
    tokenised; null texts have no tokens."""
    wanted = [r.source for r in _listed(shares).select("source").collect()]
    normal = docs.select("doc_id", "text", F.lower(F.trim("source")).alias("source")).filter(F.col("doc_id").isNotNull() & F.col("source").isin(wanted) & F.col("text").isNotNull())
    return mix_sized(token_counts(normal, "doc_id", vocabulary), shares, budget, seed)
