"""Queries over the compound, patent, trial and document tables: retrieval, label transfer, provenance, text
preparation, incremental batches and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import hashing, scores, text
from orrery.functions.filters import compile_filter
from orrery.operators import delta, evaluate, transfer
from orrery.operators.order import running_number
from orrery.operators.provenance import provenance, span
from orrery.operators.simjoin import best_ranks, count_within, label_sums, mean_similarity, nearest
from orrery.session import cut, shared_folder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- shared inputs -------------------------------------------------------------------------------------------------

ALL = """
q as (select id as qid, fp, smiles from patent_compounds where id % 50 = 0 and fp is not null),
r as (select cid as rid, fp, smiles from chembl where fp is not null),
pairs as (select qid, rid, list_sum(list_transform(range(1, 33), lambda i: bit_count(q.fp[i] & r.fp[i]))) as s,
  list_sum(list_transform(range(1, 33), lambda i: bit_count(q.fp[i] | r.fp[i]))) as u from q cross join r),
sims as (select qid, rid, case when u > 0 then round(s::double / u, 12) else 0 end as sim from pairs)"""
NB = f"""{ALL},
nb as (select * from (select *, row_number() over (partition by qid order by sim desc, rid) as rk from sims where sim >= 0.3) where rk <= 100)"""
LAB = """
tn as (select acc, row_number() over (order by acc) - 1 as i, count(*) over () as n from targets),
lab as (select cid as rid, acc as label from chembl join tn on cid % n = i union select cid, acc from chembl join tn on (cid * 7 + 3) % n = i)"""
PRED = f"""{NB}, {LAB},
sc as (select qid, label, max(sim) as conf, count(*) as support, round(sum(sim), 6) as vote from nb join lab using (rid) where rk <= 20 group by qid, label),
pred as (select *, row_number() over (partition by qid order by conf desc, support desc, vote desc, label) as rk from sc)"""


def _queries(spark, d):
    """The stated query set: every compound whose id is divisible by 50."""
    return table(spark, d, "patent_compounds").filter("id % 50 = 0 and fp is not null").select(F.col("id").alias("qid"), "fp", "smiles")


def _refs(spark, d) -> DataFrame:
    return table(spark, d, "chembl").filter("fp is not null").select("cid", "fp")


def _neighbours(spark, d) -> DataFrame:
    return nearest(_queries(spark, d).select("qid", "fp"), _refs(spark, d), 100, 0.3)


def _labels(spark, d) -> DataFrame:
    """Ligand to target: each ligand has two targets by position in the sorted target list (a dimension table)."""
    t = running_number(table(spark, d, "targets").select("acc"), ["acc"], "i")
    n = t.count()
    c = table(spark, d, "chembl").select(F.col("cid").alias("rid"), F.explode(F.array(F.col("cid") % n, (F.col("cid") * 7 + 3) % n)).alias("i"))
    return c.join(t.select(F.col("i").cast("bigint").alias("i"), F.col("acc").alias("label")), "i").select("rid", "label").distinct()


def _predicted(spark, d) -> DataFrame:
    return transfer.transfer_labels(_neighbours(spark, d), _labels(spark, d))


def _long(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _newest(spark, d, name, key) -> DataFrame:
    """The latest row of each record in the newest release."""
    t = table(spark, d, name)
    newest = t.agg(F.max("release_version")).first()[0]
    rows = t.filter(F.col("release_version") == F.lit(newest))
    return delta.keep_one(rows, [key], F.col("loaded_at").desc())


def _newest_sql(name, key):
    return f"(select * from (select *, row_number() over (partition by {key} order by loaded_at desc) as rn from {name} where release_version = (select max(release_version) from {name})) where rn = 1)"


PAT, TRI = _newest_sql("patents", "patent_number"), _newest_sql("trials", "nct_id")

# ---- nearest neighbours and label transfer -------------------------------------------------------------------------


@query(f"with {NB} select qid, rid, sim, rk from nb")
def knn_raw_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("qid", "rid", "sim", *_long("rk"))


@query(f"with {PRED} select qid, label, conf, support, vote, rk from pred")
def knn_label_transfer(spark, d):
    return _predicted(spark, d).select("qid", "label", "conf", "vote", *_long("support", "rk"))


@query(f"""with {PRED} select qid, p.label, coalesce(t.gene, '') as gene, case when conf >= 0.5 then 'HIGH' when conf >= 0.4 then 'MODERATE' when conf >= 0.3 then 'LOW' else 'NOVEL' end as band, support, rk
from (select *, row_number() over (partition by qid order by prk) as rk from (select pred.qid, pred.label, conf, support, pred.rk as prk from pred join targets t on t.acc = pred.label where (t.org is null or t.org like '%Homo sapiens%') and conf >= 0.35)) p join targets t on t.acc = p.label where rk <= 10""")
def predict_served(spark, d):
    """Human (or unknown) targets from a floor on, with gene and band, re-ranked."""
    t = table(spark, d, "targets").filter("org is null or org like '%Homo sapiens%'").select(F.col("acc").alias("label"), F.coalesce("gene", F.lit("")).alias("gene"))
    kept = _predicted(spark, d).filter("conf >= 0.35").join(t, "label").withColumnRenamed("rk", "prk")
    return transfer.rank_within(kept, "qid", F.col("prk")).filter("rk <= 10").select("qid", "label", "gene", scores.confidence_band(F.col("conf")).alias("band"), *_long("support", "rk"))


BEST = f"{NB}, bq as (select q.qid, coalesce(max(sim), 0.0) as best from q left join nb using (qid) group by q.qid)"


@query(f"with {BEST} select qid, best, best < 0.3 as novel, best >= 0.999 as exact from bq")
def knn_best_novel_exact(spark, d):
    return transfer.best_and_flags(_queries(spark, d).select("qid"), _neighbours(spark, d))


@query(f"""with {BEST}, b as (select case when best >= 0.5 then 'HIGH' when best >= 0.4 then 'MODERATE' when best >= 0.3 then 'LOW' else 'NOVEL' end as band, count(*) as n, min(-best) as o from bq group by band)
select band, n, round(100.0::double * sum(n) over (order by o) / sum(n) over (), 4) as cumulative_pct from b""")
def coverage_bands(spark, d):
    best = transfer.best_and_flags(_queries(spark, d).select("qid"), _neighbours(spark, d))
    per = best.groupBy(scores.confidence_band(F.col("best")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min(-F.col("best")).alias("o"))
    up = F.sum("n").over(Window.orderBy("o"))  # four bands
    return per.select("band", "n", F.round(100.0 * up / F.sum("n").over(Window.partitionBy()), 4).alias("cumulative_pct"))


@query(f"with {BEST} select count(*) as n, round(median(best), 6) as median_best, round(avg(best), 6) as mean_best from bq")
def coverage_summary(spark, d):
    best = transfer.best_and_flags(_queries(spark, d).select("qid"), _neighbours(spark, d))
    per = best.groupBy("best").agg(F.count(F.lit(1)).alias("m"))
    median = evaluate.weighted_median(per, "best", "m").select(F.round("median", 6).alias("median_best"))
    return best.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("best"), 6).alias("mean_best")).join(median)  # one row each


@query(f"with {PRED} select qid, label, row_number() over (partition by qid order by conf desc, support desc, label) as rk from sc qualify rk <= 10")
def knn_two_key_rank(spark, d):
    ranked = transfer.rank_within(_predicted(spark, d).drop("rk"), "qid", F.col("conf").desc(), F.col("support").desc(), F.col("label"))
    return ranked.filter("rk <= 10").select("qid", "label", *_long("rk"))


@query(f"""with {NB}, {LAB}, pop as (select label, row_number() over (order by count(*) desc, label) as p from lab group by label),
both_ as (select qid, label, 0 as src, 0 as p from nb join lab using (rid) where rk = 1 union all select q.qid, label, 1, p from q cross join pop where p <= 5)
select qid, label, row_number() over (partition by qid order by src, p, label) as rk from (select qid, label, min(src) as src, min(p) as p from both_ group by qid, label)""")
def single_nn_padded(spark, d):
    """Labels of the one nearest neighbour, filled up with the five most popular ones."""
    labels = _labels(spark, d)
    five = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label").limit(5)
    pop = five.withColumn("p", F.row_number().over(Window.orderBy(F.col("n").desc(), "label")))
    own = _neighbours(spark, d).filter("rk = 1").join(labels, "rid").select("qid", "label", F.lit(0).alias("src"), F.lit(0).alias("p"))
    pad = _queries(spark, d).select("qid").join(F.broadcast(pop.select("label", F.lit(1).alias("src"), "p")))  # five rows
    merged = own.unionByName(pad).groupBy("qid", "label").agg(F.min("src").alias("src"), F.min("p").alias("p"))
    return transfer.rank_within(merged, "qid", F.col("src"), F.col("p"), F.col("label")).select("qid", "label", *_long("rk"))


@query(f"with {LAB} select label, count(*) as n, row_number() over (order by count(*) desc, label) as rk from lab group by label qualify rk <= 20")
def popularity_rank(spark, d):
    per = _labels(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label").limit(20)
    return per.select("label", "n", F.row_number().over(Window.orderBy(F.col("n").desc(), "label")).cast("bigint").alias("rk"))


@query(f"""with {NB}, {LAB}, v as (select qid, label, sum(sim) as vote from nb join lab using (rid) group by qid, label), tot as (select qid, sum(sim) as total from nb group by qid),
sz as (select label, count(*) as n from lab group by label) select qid, label, round(vote - total * n / (select count(*) from chembl), 6) as score from v join tot using (qid) join sz using (label)""")
def enrichment_rank(spark, d):
    return transfer.enrichment(_neighbours(spark, d), _labels(spark, d), table(spark, d, "chembl").count())


@query(f"""with {ALL}, {LAB}, bg as (select avg(case when sim >= 0.4 then sim else 0 end) as m, avg(case when sim >= 0.4 then sim * sim else 0 end) as s2 from sims),
raw as (select qid, label, sum(sim) as raw from sims join lab using (rid) where sim >= 0.4 group by qid, label), sz as (select label, count(*) as n from lab group by label)
select qid, label, round((raw - n * m) / sqrt(n * greatest(s2 - m * m, 1e-12)), 6) as z from raw join sz using (label) cross join bg""")
def sea_zscore(spark, d):
    """Sums over all ligands from 0.4 on, against the mean and spread over all pairs of a query and a ligand."""
    labels = _labels(spark, d)
    refs = _refs(spark, d).join(labels.groupBy(F.col("rid").alias("cid")).agg(F.collect_list("label").alias("labels")), "cid", "left")
    sums = cut(label_sums(_queries(spark, d).select("qid", "fp"), refs, 0.4))  # read twice
    total, square, pairs = sums.filter("label is null").agg(F.sum("raw"), F.sum("square"), F.sum("n")).first()
    return transfer.set_zscore(sums.filter("label is not null"), labels, (total or 0.0) / (pairs or 1), (square or 0.0) / (pairs or 1))


@query(f"""with {LAB}, b as (select generate_series as bit from generate_series(0, 2047)),
tr as (select rid, label, bit from lab join chembl on cid = rid cross join b where fp is not null and (fp[bit // 64 + 1] >> (bit % 64)) & 1 = 1),
qb as (select id as qid, bit from patent_compounds cross join b where id % 50 = 0 and fp is not null and (fp[bit // 64 + 1] >> (bit % 64)) & 1 = 1),
sz as (select label, count(distinct rid) as n from tr group by label), cn as (select label, bit, count(*) as c from tr group by label, bit),
sc as (select qid, sz.label, sum(ln((coalesce(c, 0) + 1.0::double) / (n + 2.0::double))) as score, count(c) as seen from qb cross join sz left join cn on cn.label = sz.label and cn.bit = qb.bit group by qid, sz.label)
select qid, label, round(score, 6) as score, row_number() over (partition by qid order by round(score, 6) desc, label) as rk from sc where seen > 0 qualify rk <= 5""")
def naive_bayes_bits(spark, d):
    bits = F.flatten(F.transform("fp", lambda w, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", w, b) == 1), lambda b: b + i * 64)))
    refs = table(spark, d, "chembl").filter("fp is not null").select(F.col("cid").alias("rid"), F.explode(bits).alias("bit"))
    return transfer.naive_bayes(refs.join(_labels(spark, d), "rid"), _queries(spark, d).select("qid", "fp"), 5).select("qid", "label", "score", *_long("rk"))


@query(f"with {PRED} select qid, label, conf, row_number() over (partition by qid order by conf desc, label) as rk from sc where not (support = 1 and conf < 0.4) qualify rk <= 50")
def denoise_targets(spark, d):
    return transfer.drop_weak(_predicted(spark, d).drop("rk")).select("qid", "label", "conf", *_long("rk"))


@query(f"with {PRED} select case when support >= 8 then '8+' when support >= 4 then '4-7' when support >= 2 then '2-3' else '1' end as bucket, count(*) as n, round(avg(conf), 6) as mean_conf from sc group by bucket")
def support_buckets(spark, d):
    return _predicted(spark, d).groupBy(scores.support_bucket(F.col("support")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("conf"), 6).alias("mean_conf"))


@query(f"with {PRED} select label, qid, row_number() over (partition by label order by support desc, conf desc, qid) as place from pred where conf >= 0.5 qualify place <= 5")
def target_landscape(spark, d):
    strong = _predicted(spark, d).filter("conf >= 0.5")
    return transfer.rank_within(strong, "label", F.col("support").desc(), F.col("conf").desc(), F.col("qid"), name="place").filter("place <= 5").select("label", "qid", *_long("place"))


@query("""select case when support = 1 and confidence < 0.4 then 'drop' else 'keep' end as side, count(*) as n, count(distinct pid) as n_compounds, round(avg(confidence), 6) as mean_conf
from compound_predictions where acc is not null and support is not null and confidence is not null and not isnan(confidence) group by side""")
def floor_drop_keep(spark, d):
    t = table(spark, d, "compound_predictions").filter("acc is not null and support is not null and confidence is not null and not isnan(confidence)")
    side = F.when((F.col("support") == 1) & (F.col("confidence") < 0.4), "drop").otherwise("keep")
    return t.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pid").alias("n_compounds"), F.round(F.avg("confidence"), 6).alias("mean_conf"))


@query("""select case when grouping(t.org) = 1 then 'all' else coalesce(t.org, 'unknown') end as org, case when grouping(p.support) = 1 then -1 else p.support end as support, count(*) as n, count(distinct p.pid) as n_pids
from compound_predictions p join targets t on t.acc = p.acc where p.support is not null group by grouping sets ((t.org), (t.org, p.support), ())""")
def per_class_grains(spark, d):
    """Predictions by organism, by organism and support, and in all, in one pass of grouping sets."""
    p = table(spark, d, "compound_predictions").filter("support is not null").select("acc", "pid", "support")
    t = p.join(table(spark, d, "targets").select("acc", "org"), "acc")
    sets = t.groupingSets([["org"], ["org", "support"], []], "org", "support").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pid").alias("n_pids"), F.grouping("org").alias("go"), F.grouping("support").alias("gs"))
    return sets.select(F.when(F.col("go") == 1, "all").otherwise(F.coalesce("org", F.lit("unknown"))).alias("org"), F.when(F.col("gs") == 1, -1).otherwise(F.col("support")).alias("support"), "n", "n_pids")


LOO = f"""{LAB}, q as (select cid as qid, fp, left(smiles, 6) as scaffold from chembl where cid % 50 = 0 and fp is not null), r as (select cid as rid, fp, left(smiles, 6) as scaffold from chembl where fp is not null),
pairs as (select qid, rid, q.scaffold as qs, r.scaffold as rs, list_sum(list_transform(range(1, 33), lambda i: bit_count(q.fp[i] & r.fp[i]))) as s, list_sum(list_transform(range(1, 33), lambda i: bit_count(q.fp[i] | r.fp[i]))) as u from q cross join r),
pk as (select * from (select *, round(s::double / u, 12) as sim, row_number() over (partition by qid order by round(s::double / u, 12) desc, rid) as k from pairs where u > 0 and round(s::double / u, 12) >= 0.3))"""
EVAL = """nb as (select qid, rid, sim, row_number() over (partition by qid order by sim desc, rid) as rk from ok),
sc as (select qid, label, max(sim) as conf, count(*) as support, round(sum(sim), 6) as vote from nb join lab using (rid) where rk <= 20 group by qid, label),
pred as (select *, row_number() over (partition by qid order by conf desc, support desc, vote desc, label) as rk from sc),
hit as (select l.rid as qid, min(p.rk) as hit_at from lab l join (select distinct qid from q) a on a.qid = l.rid left join pred p on p.qid = l.rid and p.label = l.label group by l.rid)
select count(*) as n_queries, round(avg(case when hit_at <= 1 then 1.0::double else 0 end), 6) as recall_1, round(avg(case when hit_at <= 5 then 1.0::double else 0 end), 6) as recall_5, round(avg(case when hit_at <= 10 then 1.0::double else 0 end), 6) as recall_10 from hit"""


def _held_out(spark, d, **guards):
    """Recall of the first 20 neighbours that the guards of ``nearest`` admit, however many these exclude."""
    c = table(spark, d, "chembl").filter("fp is not null").select("cid", "fp", F.substring("smiles", 1, 6).alias("scaffold"))
    asked = c.filter("cid % 50 = 0")
    labels = _labels(spark, d)
    ranked = transfer.transfer_labels(nearest(asked, c, 20, 0.3, others=True, **guards), labels)
    truth = labels.withColumnRenamed("rid", "qid").join(asked.select(F.col("cid").alias("qid")), "qid")
    return evaluate.recall_at(ranked, truth)


@query(f"with {LOO}, ok as (select * from pk where qid <> rid and sim < 0.99), {EVAL}")
def loo_recall_at_k(spark, d):
    """Leave-one-out: neither the ligand itself nor anything as good as it votes."""
    return _held_out(spark, d, below=0.99)


@query(f"with {LOO}, ok as (select * from pk where qid <> rid and qs is distinct from rs), {EVAL}")
def scaffold_holdout_recall(spark, d):
    return _held_out(spark, d, apart="scaffold")


@query("""with w as (select acc, count(*) as n, count(*) filter (where confidence >= 0.5) as k from compound_predictions where acc is not null and confidence is not null and not isnan(confidence) group by acc)
select acc, n, k, round((k::double / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k::double / n * (1 - k::double / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n), 6) as low,
round((k::double / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(k::double / n * (1 - k::double / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n), 6) as high from w""")
def wilson_intervals(spark, d):
    t = table(spark, d, "compound_predictions").filter("acc is not null and confidence is not null and not isnan(confidence)")
    per = t.groupBy("acc").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.5).alias("k"))
    low, high = scores.wilson(F.col("k"), F.col("n").cast("double"))
    return per.select("acc", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""with s as (select confidence as x, case when support >= 5 then 1 else 0 end as y from compound_predictions where confidence is not null and not isnan(confidence) and support is not null),
g as (select x, sum(y) as p, count(*) as n from s group by x), r as (select *, coalesce(sum(n) over (order by x rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0::double as rank from g)
select round((sum(rank * p) - sum(p) * (sum(p) + 1) / 2.0::double) / (sum(p) * sum(n - p)), 6)::double as auc from r""")
def roc_auc(spark, d):
    t = table(spark, d, "compound_predictions").filter("not isnan(confidence) and support is not null")
    return evaluate.roc_auc(t.select("confidence", F.when(F.col("support") >= 5, 1).otherwise(0).alias("y")), "confidence", "y")


@query("""with s as (select confidence as x, case when support >= 5 then 1 else 0 end as y from compound_predictions where confidence is not null and not isnan(confidence) and support is not null),
g as (select x, sum(y) as p, count(*) as n from s group by x), r as (select p, sum(p) over (order by x desc) as tp, sum(n) over (order by x desc) as a from g)
select round(sum(tp::double / a * p) / sum(p), 6)::double as average_precision from r""")
def average_precision(spark, d):
    t = table(spark, d, "compound_predictions").filter("not isnan(confidence) and support is not null")
    return evaluate.average_precision(t.select("confidence", F.when(F.col("support") >= 5, 1).otherwise(0).alias("y")), "confidence", "y")


# ---- retrieval ------------------------------------------------------------------------------------------------------

COS = """qe as (select vec_id as qid, embedding as a, label as la from embeddings where vec_id % 50 = 0),
cs as (select qid, vec_id as rid, la, label as lb, round(list_dot_product(a::double[], embedding::double[]) / (sqrt(list_dot_product(a::double[], a::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) as sim from qe cross join embeddings where vec_id <> qid)"""


def _cosine(spark, d, k):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest(e.filter("vec_id % 50 = 0"), e, k, measure="cosine", digits=6)


@query(f"with {COS} select qid, rid, row_number() over (partition by qid order by sim desc, rid) as rk from cs qualify rk <= 10")
def similar_self_excluding(spark, d):
    near = _cosine(spark, d, 11).filter("qid <> rid").drop("rk")
    return transfer.rank_within(near, "qid", F.col("sim").desc(), F.col("rid")).filter("rk <= 10").select("qid", "rid", *_long("rk"))


@query(f"with {COS} select qid, rid, row_number() over (partition by qid order by sim desc, rid) as rk from cs where lb in (1, 2, 3) qualify rk <= 5")
def cosine_topk_filtered(spark, d):
    """The payload filter comes before the search, so every query still gets its full k."""
    e = table(spark, d, "embeddings")
    some = e.filter(compile_filter(e, {"label": [1, 2, 3]}))
    near = nearest(e.filter("vec_id % 50 = 0").select("vec_id", "embedding"), some.select("vec_id", "embedding"), 6, measure="cosine", digits=6).filter("qid <> rid").drop("rk")
    return transfer.rank_within(near, "qid", F.col("sim").desc(), F.col("rid")).filter("rk <= 5").select("qid", "rid", *_long("rk"))


@query(f"""with {ALL} select q.qid, count(*) filter (where sim >= 0.7) as n_70, count(*) filter (where sim >= 0.5) as n_50, count(*) filter (where sim >= 0.4) as n_40, count(*) filter (where sim >= 0.3) as n_30
from q left join sims using (qid) group by q.qid""")
def density_thresholds(spark, d):
    """How many of all ligands lie within each threshold: counted, not taken from a list of nearest ones."""
    floors = {"n_70": 0.7, "n_50": 0.5, "n_40": 0.4, "n_30": 0.3}
    asked = _queries(spark, d).select("qid", "fp")
    counts = count_within(asked, _refs(spark, d), floors)
    return asked.select("qid").distinct().join(counts, "qid", "left").select("qid", *[F.coalesce(n, F.lit(0)).alias(n) for n in floors])


@query(f"with {NB} select qid, rid, round(s::double / u, 6) as sim from pairs where u > 0 and s::double / u >= 0.6")
def threshold_neighbours_popcount(spark, d):
    """All pairs from 0.6 on: an equi-join on popcount buckets of 16 bits that the bound allows, then the exact bound."""
    q = _queries(spark, d).select("qid", F.col("fp").alias("a"), scores_popcount("fp").alias("pa"))
    r = table(spark, d, "chembl").filter("fp is not null").select(F.col("cid").alias("rid"), F.col("fp").alias("b"), scores_popcount("fp").alias("pb")).withColumn("bucket", F.floor(F.col("pb") / 16).cast("int"))
    reach = F.sequence(F.floor(F.col("pa") * 0.6 / 16).cast("int"), F.floor(F.col("pa") / 0.6 / 16).cast("int"))
    near = q.withColumn("bucket", F.explode(reach)).join(r, "bucket").filter(scores.popcount_band(F.col("pa"), F.col("pb"), 0.6)).withColumn("t", scores.tanimoto(F.col("a"), F.col("b")))
    return near.filter("t >= 0.6D").select("qid", "rid", F.round("t", 6).alias("sim"))


def scores_popcount(fp: str):
    return F.aggregate(fp, F.lit(0), lambda s, x: s + F.bit_count(x))


@query(f"select patent_number, country from {PAT} where country = 'US' and ipc is not null and publication_date >= date '2005-01-01' and publication_date <= date '2015-12-31'")
def filter_dsl_eq_range(spark, d):
    import datetime

    t = _newest(spark, d, "patents", "patent_number")
    wanted = {"country": "US", "publication_date": {"gte": datetime.date(2005, 1, 1), "lte": datetime.date(2015, 12, 31)}}
    return t.filter(compile_filter(t, wanted)).filter("ipc is not null").select("patent_number", "country")


@query(f"select nct_id, overall_status from {TRI} where list_has_any(conditions, ['Skin ischaemia', 'Liver colitis', 'Colon dystrophy']) and enrollment in (20, 40, 60, 100)")
def filter_dsl_array_overlap(spark, d):
    t = _newest(spark, d, "trials", "nct_id")
    return t.filter(compile_filter(t, {"conditions": ["Skin ischaemia", "Liver colitis", "Colon dystrophy"], "enrollment": [20, 40, 60, 100]})).select("nct_id", "overall_status")


@query("select id, surechembl_id, mol_weight from patent_compounds where id in (7, 21, 50, 99)")
def ids_lookup(spark, d):
    return table(spark, d, "patent_compounds").filter(F.col("id").isin(7, 21, 50, 99)).select("id", "surechembl_id", "mol_weight")


@query("select id, surechembl_id from patent_compounds where id > 100 order by id limit 25")
def keyset_page(spark, d):
    return table(spark, d, "patent_compounds").filter("id > 100").orderBy("id").limit(25).select("id", "surechembl_id")


@query("select count(*) as n from patent_compounds where mol_weight >= 300 and mol_weight <= 500")
def filtered_count(spark, d):
    t = table(spark, d, "patent_compounds")
    return t.filter(compile_filter(t, {"mol_weight": {"gte": 300, "lte": 500}})).agg(F.count(F.lit(1)).alias("n"))


# ---- provenance -----------------------------------------------------------------------------------------------------

LINK = """lk as (select item, record, min(pos) = 1 as claimed from (select cid as item, upper(trim(unnest(pat_nums))) as record, generate_subscripts(pat_nums, 1) as pos from validate_patent_text_support) where record is not null and item is not null group by item, record),
rec as (select patent_number as record, max(publication_date) as date from patents where release_version = (select max(release_version) from patents) and patent_number is not null group by patent_number)"""


def _links(spark, d):
    t = table(spark, d, "validate_patent_text_support").filter("cid is not null").select(F.col("cid").alias("item"), F.posexplode("pat_nums").alias("pos", "raw"))
    return t.filter("raw is not null").groupBy("item", F.upper(F.trim("raw")).alias("record")).agg((F.min("pos") == 0).alias("claimed"))


def _records(spark, d):
    t = table(spark, d, "patents")
    newest = t.agg(F.max("release_version")).first()[0]
    return t.filter((F.col("release_version") == F.lit(newest)) & F.col("patent_number").isNotNull()).groupBy(F.col("patent_number").alias("record")).agg(F.max("publication_date").alias("date"))


def _prov_sql(k, noise):
    return f"""with {LINK}, cnt as (select item, count(*) as n from lk group by item), dt as (select item, record, claimed, date from lk join rec using (record)),
    c as (select * from (select *, row_number() over (partition by item order by date asc nulls first, record) as up, row_number() over (partition by item order by date desc nulls last, record desc) as dn from dt where claimed) where up <= {(k + 1) // 2} or dn <= {k // 2}),
    tk as (select item, count(*) as taken from c group by item),
    o as (select * from (select dt.*, {k} - coalesce(taken, 0) as room, row_number() over (partition by item order by date asc nulls first, record) as up, row_number() over (partition by item order by date desc nulls last, record desc) as dn from dt left join tk using (item) where not claimed)
      where up <= (room + 1) // 2 or dn <= room // 2),
    s as (select item, record, claimed, date from c union all select item, record, claimed, date from o)
    select item, n, n > {noise} as noise, record, date, claimed, row_number() over (partition by item order by claimed desc, date desc nulls last, record) as place from s join cnt using (item)"""


@query(_prov_sql(4, 5))
def provenance_span(spark, d):
    return provenance(_links(spark, d), _records(spark, d), 4, 5).select("item", "n", "noise", "record", "date", "claimed", *_long("place"))


@query(_prov_sql(1, 5))
def provenance_span_one(spark, d):
    """A span of one shows one record, never the whole list."""
    return provenance(_links(spark, d), _records(spark, d), 1, 5).select("item", "n", "noise", "record", "date", "claimed", *_long("place"))


@query(f"""with {LINK}, dt as (select record, item, date from lk join rec using (record)), s as (select *, row_number() over (partition by record order by date asc nulls first, item) as up, row_number() over (partition by record order by date desc nulls last, item desc) as dn from dt)
select record, item from s where up <= 2 or dn <= 2""")
def span_per_record(spark, d):
    return span(_links(spark, d).join(_records(spark, d), "record"), "record", "date", "item", 4).select("record", "item")


LE = text.LEGAL_ENDS
_ALIAS = " ".join(f"when '{k}' then '{v}'" for k, v in text.ALIASES.items())


@query(f"""with n as (select distinct unnest(assignees) as name from patents), c as (select name, trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(replace(regexp_replace(name, '\\s*\\([A-Za-z]{{2}}\\)\\s*$', ''), '&', ' and '), '[._,-]', ' ', 'g'), '\\s+', ' ', 'g'))), '((^| )({LE}))+$', '')) as k from n where name is not null),
t as (select name, array_to_string(list_transform(regexp_extract_all(k, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), '') as a from c) select name, case a {_ALIAS} else a end as assignee from t""")
def assignee_canonical(spark, d):
    n = table(spark, d, "patents").select(F.explode("assignees").alias("name")).filter("name is not null").distinct()
    return n.select("name", text.canonical_assignee(F.col("name")).alias("assignee"))


# ---- text -----------------------------------------------------------------------------------------------------------

_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'), '<[^>]+>', '', 'g'), 'https?://\\S+|www\\.\\S+', '', 'g'))"


@query(f"select patent_number, release_version, loaded_at, md5({_CLEAN.format('description')}) as text_md5, length({_CLEAN.format('description')}) as n_chars from patents where description is not null")
def clean_text_patents(spark, d):
    c = text.clean_text(F.col("description"))
    return table(spark, d, "patents").filter("description is not null").select("patent_number", "release_version", "loaded_at", F.md5(c).alias("text_md5"), F.length(c).cast("bigint").alias("n_chars"))


@query(f"""with p as (select nct_id, brief_summary as t, list_filter(list_transform(string_split_regex(brief_summary, '[.!?]+'), lambda s: trim(s, ' ')), lambda s: s <> '') as parts from {TRI} where brief_summary is not null),
r as (select nct_id, list_reduce(list_transform(parts, lambda s: {{'done': []::varchar[], 'cur': s}}), lambda a, x: case when a.cur = '' then {{'done': a.done, 'cur': x.cur}}
  when length(a.cur) + length(x.cur) + 1 > 300 then {{'done': list_append(a.done, a.cur), 'cur': x.cur}} else {{'done': a.done, 'cur': a.cur || '. ' || x.cur}} end, {{'done': []::varchar[], 'cur': ''}}) as st from p where length(t) > 300),
c as (select nct_id, case when st.cur <> '' then list_append(st.done, st.cur) else st.done end as chunks from r union all select nct_id, [t] from p where length(t) <= 300)
select nct_id, i - 1 as chunk_id, md5(chunks[i]) as chunk_md5 from (select nct_id, chunks, unnest(range(1, len(chunks) + 1)) as i from c)""")
def sentence_chunks(spark, d):
    t = _newest(spark, d, "trials", "nct_id").filter("brief_summary is not null")
    return t.select("nct_id", F.posexplode(text.sentence_chunks(F.col("brief_summary"), 300)).alias("chunk_id", "c")).select("nct_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.md5("c").alias("chunk_md5"))


@query(f"""select nct_id, 'summary' as chunk_type, 'Summary: ' || brief_summary as body from {TRI} where length(brief_summary) >= 50
union all select nct_id, 'eligibility', 'Eligibility (' || coalesce(eligibility.gender, 'ANY') || ', ' || coalesce(eligibility.minimum_age, 'N/A') || ' to ' || coalesce(eligibility.maximum_age, 'N/A') || '): ' || eligibility.criteria from {TRI} where length(eligibility.criteria) >= 50
union all select nct_id, 'conditions', 'Conditions: ' || array_to_string(conditions, ', ') from {TRI} where len(conditions) > 0""")
def typed_document_chunks(spark, d):
    t = _newest(spark, d, "trials", "nct_id")
    e = F.col("eligibility")
    n = lambda c, other: F.coalesce(c, F.lit(other))
    parts = F.array(
        F.struct(F.lit("summary").alias("chunk_type"), F.when(F.length("brief_summary") >= 50, F.concat(F.lit("Summary: "), "brief_summary")).alias("body")),
        F.struct(F.lit("eligibility").alias("chunk_type"), F.when(F.length(e["criteria"]) >= 50, F.concat(F.lit("Eligibility ("), n(e["gender"], "ANY"), F.lit(", "), n(e["minimum_age"], "N/A"), F.lit(" to "), n(e["maximum_age"], "N/A"), F.lit("): "), e["criteria"])).alias("body")),
        F.struct(F.lit("conditions").alias("chunk_type"), F.when(F.size("conditions") > 0, F.concat(F.lit("Conditions: "), F.array_join("conditions", ", "))).alias("body")),
    )
    return t.select("nct_id", F.inline(parts)).filter("body is not null")


@query(f"select patent_number, md5(concat_ws(' ', title, title, description)) as text_md5, title is not null or description is not null as has_text from {PAT} where title is not null or length(description) >= 50")
def searchable_text(spark, d):
    t = _newest(spark, d, "patents", "patent_number").filter("title is not null or length(description) >= 50")
    return t.select("patent_number", F.md5(text.searchable_text(F.col("title"), F.col("description"))).alias("text_md5"), (F.col("title").isNotNull() | F.col("description").isNotNull()).alias("has_text"))


@query(f"""with o as (select * from (select origin_key, text, added_at, doc_id, row_number() over (partition by origin_key order by added_at desc, doc_id desc) as rn from documents where text is not null and trim(text) <> '') where rn = 1)
select patent_number, o.doc_id is not null as has_full_text, case when o.doc_id is not null then 'overlay' when description is not null then 'own' else 'none' end as text_source, length(coalesce(o.text, description, '')) as n_chars from {PAT} p left join o on o.origin_key = p.patent_number""")
def overlay_later_wins(spark, d):
    docs = delta.keep_one(table(spark, d, "documents").filter("text is not null and trim(text) <> ''"), ["origin_key"], F.col("added_at").desc(), F.col("doc_id").desc())
    p = _newest(spark, d, "patents", "patent_number").select("patent_number", "description")
    j = p.join(docs.select(F.col("origin_key").alias("patent_number"), "text", "doc_id"), "patent_number", "left")
    source = F.when(F.col("doc_id").isNotNull(), "overlay").when(F.col("description").isNotNull(), "own").otherwise("none")
    return j.select("patent_number", F.col("doc_id").isNotNull().alias("has_full_text"), source.alias("text_source"), F.length(F.coalesce("text", "description", F.lit(""))).cast("bigint").alias("n_chars"))


@query(f"select patent_number, replace(regexp_replace(patent_number, '-[A-Z]\\d?$', ''), '-', '') as compact from {PAT} where patent_number is not null")
def patent_number_format(spark, d):
    return _newest(spark, d, "patents", "patent_number").filter("patent_number is not null").select("patent_number", text.compact_number(F.col("patent_number")).alias("compact"))


@query(f"select code_class, count(*) as n, count(distinct patent_number) as n_patents from (select patent_number, substr(replace(unnest(list_distinct(coalesce(ipc, []) || coalesce(cpc, []))), ' ', ''), 1, 4) as code_class from {PAT}) where code_class is not null group by code_class")
def code_classes(spark, d):
    """Classes of the union of two code lists."""
    none = F.array().cast("array<string>")
    codes = F.array_union(F.coalesce("ipc", none), F.coalesce("cpc", none))
    t = _newest(spark, d, "patents", "patent_number").select("patent_number", F.explode(codes).alias("code")).filter("code is not null")
    return t.groupBy(text.code_class(F.col("code")).alias("code_class")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patent_number").alias("n_patents"))


@query("""select gene, count(distinct doc_id) as n_docs from (select doc_id, unnest(string_split(regexp_replace(text, '[^A-Za-z0-9-]+', ' ', 'g'), ' ')) as w from documents where text is not null) join (select distinct gene from targets where gene is not null) on w = gene group by gene""")
def gene_mentions(spark, d):
    """Documents naming a gene as a word: words are joined to symbols, no document meets every symbol."""
    words = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split(F.regexp_replace("text", "[^A-Za-z0-9-]+", " "), " ")).alias("gene")).distinct()
    genes = table(spark, d, "targets").filter("gene is not null").select("gene").distinct()
    return words.join(genes, "gene").groupBy("gene").agg(F.count(F.lit(1)).alias("n_docs"))


@query("select acc, case when len(string_split(h, '|')) >= 3 then string_split(h, '|')[2] else string_split(h, '|')[1] end as parsed from (select acc, case when length(acc) = 6 then 'sp|' || acc || '|X_Y' else acc end as h from targets)")
def header_accessions(spark, d):
    t = table(spark, d, "targets").select("acc", F.when(F.length("acc") == 6, F.concat(F.lit(">sp|"), "acc", F.lit("|X_Y some protein"))).otherwise(F.col("acc")).alias("h"))
    return t.select("acc", text.accession(F.col("h")).alias("parsed"))


@query("select o_orderkey, case when substr(s, 1, 2)::int >= 90 then strptime('19' || s, '%Y%m%d')::date else strptime('20' || s, '%Y%m%d')::date end as parsed from (select o_orderkey, strftime(o_orderdate, '%y%m%d') as s from orders)")
def short_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.short_date(F.date_format("o_orderdate", "yyMMdd")).alias("parsed"))


# ---- ids, deltas and writes -------------------------------------------------------------------------------------------


@query("select nct_id, (('0x' || substr(sha256(nct_id), 1, 16))::ubigint & 9223372036854775807)::bigint as point_id from (select distinct nct_id from trials)")
def stable_point_id(spark, d):
    return table(spark, d, "trials").select("nct_id").distinct().select("nct_id", hashing.point_id(F.col("nct_id")).alias("point_id"))


_HASH = "sha256(concat_ws('|', 'brief_title:' || coalesce(brief_title, ''), 'overall_status:' || coalesce(overall_status, ''), 'phase:' || coalesce(phase, ''), 'criteria:' || coalesce(eligibility.criteria, '')))"


def _hash():
    return hashing.content_hash(brief_title=F.col("brief_title"), overall_status=F.col("overall_status"), phase=F.col("phase"), criteria=F.col("eligibility.criteria"))


@query(f"select nct_id, {_HASH} as content_hash from {TRI}")
def content_hash(spark, d):
    return _newest(spark, d, "trials", "nct_id").select("nct_id", _hash().alias("content_hash"))


def _releases(spark, d):
    latest = delta.keep_one(table(spark, d, "trials"), ["nct_id", "release_version"], F.col("loaded_at").desc()).select("release_version", "nct_id", _hash().alias("h"))
    names = [r[0] for r in table(spark, d, "trials").select("release_version").distinct().orderBy("release_version").collect()]  # the calendar
    return latest, names


REL = f"t as (select release_version, nct_id, {_HASH} as h from (select *, row_number() over (partition by nct_id, release_version order by loaded_at desc) as rn from trials) where rn = 1), rv as (select list(distinct release_version order by release_version) as v from trials)"


@query(f"with {REL}, n as (select t.* from t, rv where release_version = v[-1]), o as (select t.* from t, rv where release_version = v[-2]) select n.nct_id, case when o.h is null then 'new' when o.h <> n.h then 'changed' else 'unchanged' end as status from n left join o using (nct_id)")
def delta_status(spark, d):
    t, names = _releases(spark, d)
    return delta.compare_state(t.filter(F.col("release_version") == names[-1]), t.filter(F.col("release_version") == names[-2]).select("nct_id", "h"), "nct_id", "h")


@query(f"with {REL} select nct_id from t, rv where release_version = v[-1] and nct_id not in (select nct_id from t, rv where release_version = v[1])")
def delta_unseen(spark, d):
    t, names = _releases(spark, d)
    return delta.unseen(t.filter(F.col("release_version") == names[-1]), t.filter(F.col("release_version") == names[0]), "nct_id").select("nct_id")


@query(f"with {REL}, n as (select nct_id, h from t, rv where release_version = v[-1]) select nct_id, h from n union all select t.nct_id, t.h from t, rv where release_version = v[1] and t.nct_id not in (select nct_id from n)")
def upsert_releases(spark, d):
    t, names = _releases(spark, d)
    base, patch = (t.filter(F.col("release_version") == r).select("nct_id", "h") for r in (names[0], names[-1]))
    once = delta.upsert(base, patch, ["nct_id"])
    return delta.upsert(once, patch, ["nct_id"])  # idempotent


@query("select acc, pid, confidence from (select *, row_number() over (partition by acc, pid order by scored_at desc, confidence desc nulls last) as rn from compound_predictions where acc is not null) where rn = 1 and not isnan(confidence)")
def last_scored_wins(spark, d):
    t = table(spark, d, "compound_predictions").filter("acc is not null")
    return delta.keep_one(t, ["acc", "pid"], F.col("scored_at").desc(), F.col("confidence").desc_nulls_last()).filter("confidence is not null and not isnan(confidence)").select("acc", "pid", "confidence")


@query("select min(doc_id) as doc_id, count(*) as n_copies from documents where text is not null group by text having count(*) > 1")
def dedup_keep_first(spark, d):
    t = table(spark, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
    return t.filter("n_copies > 1").select("doc_id", "n_copies")


@query("with p as (select id, mol_weight from patent_compounds), f as (select pid as id, max(confidence) as best from compound_predictions where not isnan(confidence) group by pid) select p.id, case when f.id is not null then f.best else p.mol_weight end as mol_weight from p left join f using (id)")
def payload_patch(spark, d):
    best = table(spark, d, "compound_predictions").filter("confidence is not null and not isnan(confidence)").groupBy(F.col("pid").alias("id")).agg(F.max("confidence").alias("mol_weight"))
    return delta.patch_column(table(spark, d, "patent_compounds").select("id", "mol_weight"), best, "id", "mol_weight")


@query("select count(*) as n_rows, count(distinct nct_id) as n_records, min(loaded_at) as first_load, max(loaded_at) as last_load, count(distinct release_version) as n_releases from trials")
def state_stats(spark, d):
    return table(spark, d, "trials").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("nct_id").alias("n_records"), F.min("loaded_at").alias("first_load"), F.max("loaded_at").alias("last_load"), F.countDistinct("release_version").alias("n_releases"))


@query("select release_version, n, rk from (select release_version, count(*) as n, row_number() over (order by release_version desc) as rk from patents group by release_version) where rk <= 2")
def keep_latest_releases(spark, d):
    per = table(spark, d, "patents").groupBy("release_version").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("rk", F.row_number().over(Window.orderBy(F.col("release_version").desc())).cast("bigint")).filter("rk <= 2")  # a calendar


@query("select id from patent_compounds order by md5('7:' || id::varchar), id limit 100")
def hash_sample(spark, d):
    """A reproducible sample; the limit is the feature."""
    return table(spark, d, "patent_compounds").orderBy(hashing.hash_order(7, F.col("id")), "id").limit(100).select("id")


# ---- nested records, chains and reports ---------------------------------------------------------------------------------


@query("select o_orderkey, c_name, n_name, r_name, count(l_linenumber) as n_lines, round(sum(l_quantity), 2) as quantity from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join lineitem on l_orderkey = o_orderkey group by all")
def star_left_join(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")
    return o.join(c, "c_custkey", "left").join(lines, "o_orderkey", "left").select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "quantity")


@query(f"select nct_id, len(sponsors) as n_sponsors, array_to_string(list_sort(list_transform(sponsors, lambda s: coalesce(s.lead_or_collaborator, '') || ':' || coalesce(s.agency_class, ''))), ';') as roles from {TRI} where sponsors is not null")
def nested_sponsors(spark, d):
    t = _newest(spark, d, "trials", "nct_id").filter("sponsors is not null")
    role = lambda s: F.concat(F.coalesce(s["lead_or_collaborator"], F.lit("")), F.lit(":"), F.coalesce(s["agency_class"], F.lit("")))
    return t.select("nct_id", F.size("sponsors").cast("bigint").alias("n_sponsors"), F.array_join(F.array_sort(F.transform("sponsors", role)), ";").alias("roles"))


@query("select l_orderkey, count(*) as n, array_to_string(list(l_partkey::varchar || 'x' || l_quantity::int::varchar order by l_linenumber, l_partkey, l_quantity), ',') as parts from lineitem group by l_orderkey")
def nested_collect(spark, d):
    t = table(spark, d, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_quantity")
    parts = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["l_partkey"].cast("string"), F.lit("x"), x["l_quantity"].cast("int").cast("string")))
    return t.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(parts, ",").alias("parts"))


@query("""with a as (select user_id, event_type, round(sum(value), 4) as total, count(*) as n from events group by user_id, event_type), u as (select user_id, sum(total) as all_total, count(*) as n_types from a group by user_id)
select user_id, event_type, total, n, n_types, round(100 * total / all_total, 1) as pct, row_number() over (partition by user_id order by total desc, event_type) as place from a join u using (user_id) qualify place <= 3""")
def summary_top_terms(spark, d):
    a = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id")
    full = a.withColumn("all_total", F.sum("total").over(w)).withColumn("n_types", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(F.col("total").desc(), "event_type")))
    return full.filter("place <= 3").select("user_id", "event_type", "total", "n", "n_types", F.round(100 * F.col("total") / F.col("all_total"), 1).alias("pct"), *_long("place"))


@query("""select f as field, sum(v) as n, round(100.0::double * sum(v) / sum(total), 4) as pct from (select coverage.total as total, unnest(['with_sponsors', 'with_facilities', 'with_study_arms', 'with_conditions', 'with_interventions']) as f,
unnest([coverage.with_sponsors, coverage.with_facilities, coverage.with_study_arms, coverage.with_conditions, coverage.with_interventions]) as v from tier1_coverage_stats) group by f""")
def field_coverage(spark, d):
    names = ["with_sponsors", "with_facilities", "with_study_arms", "with_conditions", "with_interventions"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"coverage.{n}").alias("v")) for n in names]))
    t = table(spark, d, "tier1_coverage_stats").select("coverage.total", each.alias("x")).select("total", "x.field", "x.v")
    return t.groupBy("field").agg(F.sum("v").alias("n"), F.round(100.0 * F.sum("v") / F.sum("total"), 4).alias("pct"))


@query("""select country, sum(n) as n from (select unnest(map_keys(top_countries)) as country, unnest(map_values(top_countries)) as n from tier1_coverage_stats) where country <> 'nan' group by country order by n desc, country limit 10""")
def top_values(spark, d):
    t = table(spark, d, "tier1_coverage_stats").select(F.explode("top_countries").alias("country", "n")).filter("country <> 'nan'")
    return t.groupBy("country").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "country").limit(10)


@query("select pos, round(avg(v), 6) as mean from (select unnest(range(0, len(embedding))) as pos, unnest(embedding)::double as v from embeddings) group by pos")
def mean_vector(spark, d):
    return table(spark, d, "embeddings").select(F.posexplode("embedding").alias("pos", "v")).groupBy(F.col("pos").cast("bigint").alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query(f"""with {COS}, bg as (select rid, sum(round(sim * 1000000)::bigint)::double / count(*) / 1000000 as b from cs group by rid) select qid, rid, row_number() over (partition by qid order by round(sim - b, 6) desc, rid) as rk from cs join bg using (rid) qualify rk <= 3""")
def debiased_rank(spark, d):
    """Similarity less the mean affinity of the row to all queries, among all rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = e.filter("vec_id % 50 = 0")
    bias = mean_similarity(asked, e, measure="cosine", digits=6).withColumnRenamed("rid", "vec_id")
    near = nearest(asked, e.join(bias, "vec_id").select("vec_id", "embedding", "mean"), 3, measure="cosine", digits=6, others=True, less="mean")
    return near.select("qid", "rid", *_long("rk"))


@query(f"with {COS} select qid, lb as label, min(rk) as best_rank from (select qid, lb, row_number() over (partition by qid order by sim desc, rid) as rk from cs) group by qid, lb")
def best_rank_per_label(spark, d):
    """The place of every label's best row among all rows, however far down."""
    e = table(spark, d, "embeddings")
    found = best_ranks(e.filter("vec_id % 50 = 0").select("vec_id", "embedding"), e.select("vec_id", "embedding", "label"), measure="cosine", digits=6)
    return found.select("qid", "label", F.col("rank").alias("best_rank"))


@query("""with p as (select distinct cid, upper(trim(a)) as acc, c from (select cid, unnest(pred_accs) as a, unnest(pred_confs) as c from validate_patent_text_support) where a is not null and trim(a) <> ''),
k as (select cid, acc, max(c) as conf from p group by cid, acc), r as (select *, row_number() over (partition by cid order by conf desc nulls last, acc) as rk from k)
select cid, acc, case when rk <= 10 and conf >= 0.5 then 'confirms' when rk > 50 then 'suggests_other' else 'weak' end as verdict from r""")
def text_support_badges(spark, d):
    pair = F.explode(F.arrays_zip("pred_accs", "pred_confs")).alias("x")
    t = table(spark, d, "validate_patent_text_support").select("cid", pair).select("cid", F.upper(F.trim("x.pred_accs")).alias("acc"), F.col("x.pred_confs").alias("c")).filter("acc <> ''")
    k = transfer.rank_within(t.groupBy("cid", "acc").agg(F.max("c").alias("conf")), "cid", F.col("conf").desc_nulls_last(), F.col("acc"))
    return k.select("cid", "acc", F.when((F.col("rk") <= 10) & (F.col("conf") >= 0.5), "confirms").when(F.col("rk") > 50, "suggests_other").otherwise("weak").alias("verdict"))


@query("select l_suppkey, l_partkey, price, rk from (select l_suppkey, l_partkey, max(l_extendedprice) as price, row_number() over (partition by l_suppkey order by max(l_extendedprice) desc, l_partkey) as rk from lineitem where l_discount >= 0.03 group by l_suppkey, l_partkey) where rk <= 3")
def topk_hits_per_query(spark, d):
    t = table(spark, d, "lineitem").filter("l_discount >= 0.03D").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("price"))
    return transfer.rank_within(t, "l_suppkey", F.col("price").desc(), F.col("l_partkey")).filter("rk <= 3").select("l_suppkey", "l_partkey", "price", *_long("rk"))


@query(f"""with {COS}, nn as (select qid, rid, la, lb from cs qualify row_number() over (partition by qid order by sim desc, rid) <= 30) select qid, rid from nn where la <> lb and (la % 3) = (lb % 3)""")
def twilight_pairs(spark, d):
    """Vector neighbours that are not of the query's own family but share a domain with it."""
    near = transfer.rank_within(_cosine(spark, d, 31).filter("qid <> rid").drop("rk"), "qid", F.col("sim").desc(), F.col("rid")).filter("rk <= 30")
    e = table(spark, d, "embeddings").select("vec_id", "label")
    pairs = near.join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("la")), "qid").join(e.select(F.col("vec_id").alias("rid"), F.col("label").alias("lb")), "rid")
    return pairs.filter("la <> lb and la % 3 = lb % 3").select("qid", "rid")


@query("select distinct p_brand, r_name from part join lineitem on l_partkey = p_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey")
def multi_hop_chain(spark, d):
    edges = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    place = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return edges.join(place.select(F.col("s_suppkey").alias("l_suppkey"), "r_name"), "l_suppkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("p_brand", "r_name").distinct()


@query("""select p.id, case when c.acc is not null then c.acc else x.acc end as primary_acc, case when c.acc is not null then 'confident' when x.acc is not null then 'any' end as via from patent_compounds p
left join (select pid, arg_max(acc, (confidence, acc)) as acc from compound_predictions where acc is not null and confidence >= 0.7 and not isnan(confidence) group by pid) c on c.pid = p.id
left join (select pid, min(acc) as acc from compound_predictions where acc is not null group by pid) x on x.pid = p.id""")
def priority_fallback(spark, d):
    """The best confident target, else the first of any."""
    t = table(spark, d, "compound_predictions").filter("acc is not null")
    good = F.when((F.col("confidence") >= 0.7) & ~F.isnan("confidence"), F.struct("confidence", "acc"))
    per = t.groupBy(F.col("pid").alias("id")).agg(F.max(good).alias("g"), F.min("acc").alias("a"))
    j = table(spark, d, "patent_compounds").select("id").join(per, "id", "left")
    return j.select("id", F.coalesce("g.acc", "a").alias("primary_acc"), F.when(F.col("g").isNotNull(), "confident").when(F.col("a").isNotNull(), "any").alias("via"))


@query("""select event_type, coalesce(json_extract_string(props, '$.k'), 'none') as k, count(*) as n from events group by all""")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy("event_type", F.coalesce(k, F.lit("none")).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""with recursive g as (select origin_key as grp, count(*) as n, row_number() over (order by count(*) desc, origin_key) as i from documents where origin_key is not null group by origin_key),
l as (select 0.8::double * sum(n) as most from g), f as (select 0::bigint as i, 0::bigint as used, null::varchar as grp, 0::bigint as n, false as in_train
union all select g.i, case when f.used + g.n <= l.most then f.used + g.n else f.used end, g.grp, g.n, f.used + g.n <= l.most from f join g on g.i = f.i + 1, l) select grp, n, in_train from f where i > 0""")
def group_split(spark, d):
    """Whole groups to train, largest first, while they fit into 80 %. Equal sizes fit alike, so only the table of
    different sizes (at most sqrt(2 rows) of them) is folded on the driver."""
    g = table(spark, d, "documents").filter("origin_key is not null").groupBy(F.col("origin_key").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    sizes = g.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.col("n").desc()).collect()
    limit, used, take = 0.8 * sum(r.n * r.m for r in sizes), 0, []
    for r in sizes:
        fit = min(r.m, int((limit - used) // r.n))
        used += fit * r.n
        take.append((r.n, fit))
    fits = F.broadcast(spark.createDataFrame(take, "n bigint, fit bigint"))
    numbered = cut(running_number(g, ["n", "grp"], "i"))  # singletons can be most groups, so no window over one size
    first = numbered.groupBy("n").agg(F.min("i").alias("lo"))
    return numbered.join(F.broadcast(first), "n").join(fits, "n").select("grp", "n", (F.col("i") - F.col("lo") < F.col("fit")).alias("in_train"))


# ---- streams ------------------------------------------------------------------------------------------------------------


@query("select time_bucket(interval '1 day', ts)::date as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_windows(spark, d):
    from orrery.streaming.incremental import event_windows, events_stream, run_to_memory

    out = run_to_memory(event_windows(events_stream(spark, d), late="60 days"), "orrery_windows")
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "total")


@query("select count(*) as n, count(distinct user_id) as n_users from (select distinct event_id, user_id from events)")
def stream_dedup(spark, d):
    from orrery.streaming.incremental import distinct_batches, distinct_rows, events_stream

    path = f"{shared_folder(spark)}/distinct-{uuid.uuid4().hex}"
    pairs = events_stream(spark, d).select("event_id", "user_id")
    distinct_batches(pairs, f"{path}/rows", f"{path}/state").awaitTermination()
    out = distinct_rows(spark, f"{path}/rows", pairs.schema)
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


# ---- classifier ---------------------------------------------------------------------------------------------------------


@query()
def qsar_fit(spark, d):
    """Logistic regression from fingerprint bits to 'has a confident target', whole scaffold groups held out."""
    from orrery.operators.qsar import fit_and_score

    good = table(spark, d, "compound_predictions").filter("confidence >= 0.7D and not isnan(confidence)").select(F.col("pid").alias("id")).distinct().withColumn("y", F.lit(1.0))
    t = table(spark, d, "patent_compounds").filter("fp is not null and smiles is not null").join(good, "id", "left")
    return fit_and_score(t.select("id", "fp", F.substring("smiles", 1, 6).alias("grp"), F.coalesce("y", F.lit(0.0)).alias("label")))
