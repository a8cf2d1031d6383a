"""More queries over the record tables: filters, joins by several keys, rankings without duplicates, measures of
predictions, text and id expressions, and the support that texts give to predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import records as R
from orrery.functions import scores
from orrery.operators import evaluate, simjoin, transfer
from orrery.operators.hotkeys import exact_quantiles
from orrery.operators.order import first_occurrences, running_number
from orrery.plans.library import COS, EVAL, LAB, LOO, NB, PAT, TRI, _cosine, _labels, _long, _neighbours, _newest, _queries
from orrery.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- shared inputs ----------------------------------------------------------------------------------------------------

LATEST = "pr as (select pid, acc, confidence, support from (select *, row_number() over (partition by pid, acc order by scored_at desc, confidence desc nulls last, support desc nulls last) as rn from compound_predictions where acc is not null and pid is not null) where rn = 1 and confidence is not null and not isnan(confidence))"
TRUTH = "tv as (select distinct cid as pid, acc from (select cid, upper(trim(unnest(pred_accs))) as acc from validate_patent_text_support) where acc <> '' and cid is not null)"


def _latest(spark, d) -> DataFrame:
    t = table(spark, d, "compound_predictions").filter("acc is not null and pid is not null").select("pid", "acc", "scored_at", "confidence", "support")
    best = F.max_by(F.struct("confidence", "support"), F.struct("scored_at", F.coalesce("confidence", F.lit(float("-inf"))), F.coalesce("support", F.lit(-1))))
    return t.groupBy("pid", "acc").agg(best.alias("x")).select("pid", "acc", "x.confidence", "x.support").filter("confidence is not null and not isnan(confidence)")


def _truth(spark, d) -> DataFrame:
    t = table(spark, d, "validate_patent_text_support").filter("cid is not null")
    return t.select(F.col("cid").alias("pid"), F.explode("pred_accs").alias("a")).select("pid", F.upper(F.trim("a")).alias("acc")).filter("acc <> ''").distinct()


# ---- filters ------------------------------------------------------------------------------------------------------------


@query(r"""select id, n from (select id, len(list_filter(regexp_extract_all(smiles, '\[[^\]]*\]|Cl|Br|[BCNOPSFIbcnops]'), lambda a: not regexp_full_match(a, '\[[0-9]*H[0-9+-]*\]'))) as n
from patent_compounds where smiles is not null) where n >= 10""")
def drug_like(spark, d):
    """Compounds of at least ten heavy atoms."""
    t = table(spark, d, "patent_compounds").filter("smiles is not null").select("id", R.heavy_atoms(F.col("smiles")).cast("bigint").alias("n"))
    return t.filter("n >= 10")


@query(f"with {LATEST}, {TRUTH} select pid, acc, confidence, tv.acc is not null as known from pr left join tv using (pid, acc) where confidence >= 0.6 or tv.acc is not null")
def floor_keep_known(spark, d):
    """Predictions from a floor on, and known ones below it."""
    known = _truth(spark, d).withColumn("k", F.lit(True))
    t = _latest(spark, d).join(known, ["pid", "acc"], "left").withColumn("known", F.col("k").isNotNull())
    return t.filter("confidence >= 0.6D or known").select("pid", "acc", "confidence", "known")


@query(f"select nct_id, coalesce(overall_status <> 'WITHDRAWN', true) as kept_exactly from {TRI} where coalesce(upper(trim(overall_status)) <> 'WITHDRAWN', true)")
def not_withdrawn(spark, d):
    """Without withdrawn trials in any spelling; whether the exact spelling alone would have kept them; no status stays."""
    t = _newest(spark, d, "trials", "nct_id").filter(F.coalesce(F.upper(F.trim("overall_status")) != "WITHDRAWN", F.lit(True)))
    return t.select("nct_id", F.coalesce(F.col("overall_status") != "WITHDRAWN", F.lit(True)).alias("kept_exactly"))


@query(f"select nct_id from {TRI} where study_type is null or upper(trim(study_type)) not in ('OBSERVATIONAL', 'EXPANDED_ACCESS')")
def exclude_kinds(spark, d):
    t = _newest(spark, d, "trials", "nct_id")
    return t.filter(F.col("study_type").isNull() | ~F.upper(F.trim("study_type")).isin("OBSERVATIONAL", "EXPANDED_ACCESS")).select("nct_id")


@query("select release_version, country, count(*) as n from patents where year(publication_date) between 2000 and 2010 and country in ('US', 'EP') group by all")
def file_index_range(spark, d):
    t = table(spark, d, "patents").filter("publication_date >= date '2000-01-01' and publication_date < date '2011-01-01' and country in ('US', 'EP')")
    return t.groupBy("release_version", "country").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with t as (select * from {TRI}), c as (select nct_id, 0 as chunk_no, 'title' as chunk_type, 'Title: ' || official_title as body from t where official_title <> '' union all select nct_id, 1, 'summary', 'Summary: ' || brief_summary from t where length(brief_summary) >= 50
union all select nct_id, 2, 'eligibility', 'Eligibility: ' || eligibility.criteria from t where length(eligibility.criteria) >= 50 union all select nct_id, 3, 'demographics', 'Gender: ' || coalesce(eligibility.gender, 'ALL') || ', age ' || coalesce(eligibility.minimum_age, 'N/A') || ' to ' || coalesce(eligibility.maximum_age, 'N/A') from t where eligibility is not null
union all select nct_id, 4, 'conditions', 'Conditions: ' || array_to_string(conditions, ', ') from t where len(conditions) > 0 union all select nct_id, 5, 'sponsors', 'Sponsors: ' || array_to_string(list_transform(sponsors, lambda s: s.sponsor_name), '; ') from t where len(sponsors) > 0)
select nct_id, chunk_no, chunk_type, md5(body) as body_md5, overall_status, phase, study_type, enrollment from c join t using (nct_id)""")
def chunks_with_fields(spark, d):
    """All chunk types of a trial, each with the same fields of its trial beside it."""
    t, e = _newest(spark, d, "trials", "nct_id"), F.col("eligibility")
    n = lambda c, other: F.coalesce(c, F.lit(other))
    text = lambda kind, head, body, ok: F.struct(F.lit(kind).alias("chunk_type"), F.when(ok, F.concat(F.lit(head), body)).alias("body"))
    kinds = F.array(
        text("title", "Title: ", F.col("official_title"), F.col("official_title") != ""), text("summary", "Summary: ", F.col("brief_summary"), F.length("brief_summary") >= 50),
        text("eligibility", "Eligibility: ", e["criteria"], F.length(e["criteria"]) >= 50),
        text("demographics", "Gender: ", F.concat(n(e["gender"], "ALL"), F.lit(", age "), n(e["minimum_age"], "N/A"), F.lit(" to "), n(e["maximum_age"], "N/A")), e.isNotNull()),
        text("conditions", "Conditions: ", F.array_join("conditions", ", "), F.size("conditions") > 0),
        text("sponsors", "Sponsors: ", F.array_join(F.transform("sponsors", lambda s: s["sponsor_name"]), "; "), F.size("sponsors") > 0),
    )
    rows = t.select("nct_id", F.posexplode(kinds).alias("chunk_no", "c"), "overall_status", "phase", "study_type", "enrollment")
    return rows.filter("c.body is not null").select("nct_id", "chunk_no", "c.chunk_type", F.md5("c.body").alias("body_md5"), "overall_status", "phase", "study_type", "enrollment")


# ---- joins --------------------------------------------------------------------------------------------------------------


@query(f"with {NB} select qid, rid, sim, c.smiles from nb join chembl c on c.cid = rid")
def neighbours_smiles(spark, d):
    names = table(spark, d, "chembl").select(F.col("cid").alias("rid"), "smiles")
    return _neighbours(spark, d).join(names, "rid").select("qid", "rid", "sim", "smiles")


@query("select doc_id from documents where origin_key in (select patent_number from patents where country = 'US')")
def kept_ids_semi(spark, d):
    kept = table(spark, d, "patents").filter("country = 'US'").select(F.col("patent_number").alias("origin_key")).distinct()
    return table(spark, d, "documents").select("doc_id", "origin_key").join(kept, "origin_key", "left_semi").select("doc_id")


@query("select cid, count(*) as n_named, count(distinct upper(trim(k))) as n_different from (select cid, unnest(pat_nums) as k from validate_patent_text_support where cid in (select pid from compound_predictions where confidence >= 0.9 and not isnan(confidence))) where k is not null group by cid")
def lists_of_kept_ids(spark, d):
    """Rows are kept by their key before their lists are read."""
    kept = table(spark, d, "compound_predictions").filter("confidence >= 0.9D and not isnan(confidence)").select(F.col("pid").alias("cid")).distinct()
    t = table(spark, d, "validate_patent_text_support").join(kept, "cid", "left_semi").select("cid", F.explode("pat_nums").alias("k")).filter("k is not null")
    return t.groupBy("cid").agg(F.count(F.lit(1)).alias("n_named"), F.countDistinct(F.upper(F.trim("k"))).alias("n_different"))


@query("""with h as (select gene, min(acc) as human from targets where org like '%Homo sapiens%' and gene is not null group by gene)
select acc, coalesce(case when org like '%Homo sapiens%' then acc end, human, acc) as human_acc from targets left join h using (gene)""")
def ortholog_to_human(spark, d):
    t = table(spark, d, "targets").select("acc", "gene", "org")
    human = t.filter("org like '%Homo sapiens%' and gene is not null").groupBy("gene").agg(F.min("acc").alias("human"))
    own = F.when(F.col("org").like("%Homo sapiens%"), F.col("acc"))
    return t.join(human, "gene", "left").select("acc", F.coalesce(own, "human", "acc").alias("human_acc"))


@query("""with k as (select id, substr(inchi_key, 1, 14) as k from patent_compounds where inchi_key <> ''), e as (select distinct k, acc from k join compound_predictions on pid = id where acc is not null)
select id, acc from k join e using (k) where id % 50 = 0 union select pid, acc from compound_predictions where pid % 50 = 0 and acc is not null""")
def bridged_labels(spark, d):
    """Labels of a compound and of those with the same skeleton key: labels of a key are made different before the join."""
    k = table(spark, d, "patent_compounds").filter("inchi_key <> ''").select("id", F.substring("inchi_key", 1, 14).alias("k"))
    p = table(spark, d, "compound_predictions").filter("acc is not null").select(F.col("pid").alias("id"), "acc").distinct()
    per_key = p.join(k, "id").select("k", "acc").distinct()
    return k.filter("id % 50 = 0").join(per_key, "k").select("id", "acc").unionByName(p.filter("id % 50 = 0")).distinct()


@query("""with n as (select inchi_key, min(surechembl_id) as name from patent_compounds where id % 3 = 0 and inchi_key <> '' group by inchi_key), p as (select substr(inchi_key, 1, 14) as k, arg_min(name, inchi_key) as name from n group by 1)
select c.id, coalesce(n.name, p.name) as name, case when n.name is not null then 'key' when p.name is not null then 'prefix' else 'none' end as via from patent_compounds c left join n using (inchi_key) left join p on p.k = substr(c.inchi_key, 1, 14)""")
def name_prefix_fallback(spark, d):
    """A name by the whole key, else by its first part."""
    t = table(spark, d, "patent_compounds").select("id", "inchi_key", "surechembl_id").withColumn("k", F.substring("inchi_key", 1, 14))
    names = t.filter("id % 3 = 0 and inchi_key <> ''").groupBy("inchi_key", "k").agg(F.min("surechembl_id").alias("name"))
    prefix = names.groupBy("k").agg(F.min_by("name", "inchi_key").alias("other"))
    j = t.select("id", "inchi_key", "k").join(names.drop("k"), "inchi_key", "left").join(prefix, "k", "left")
    via = F.when(F.col("name").isNotNull(), "key").when(F.col("other").isNotNull(), "prefix").otherwise("none")
    return j.select("id", F.coalesce("name", "other").alias("name"), via.alias("via"))


PARTNER = "tn2 as (select acc, org, md5(acc) as h, row_number() over (partition by org order by md5(acc), acc) as r, count(*) over (partition by org) as n from targets), pn as (select a.acc, b.acc as partner from tn2 a join tn2 b on a.org is not distinct from b.org and b.r = a.r % a.n + 1 where a.acc <> b.acc)"


def _partners(spark, d) -> DataFrame:
    """(acc, partner): another target of the same class, the next one in a hashed order, the last one meeting the first."""
    t = table(spark, d, "targets").select("acc", F.coalesce("org", F.lit("")).alias("org"), F.md5("acc").alias("h"))
    numbered = cut(running_number(t, ["org", "h", "acc"], "i"))
    span = numbered.groupBy("org").agg(F.min("i").alias("lo"), F.count(F.lit(1)).alias("n"))
    asked = numbered.join(span, "org").select("acc", ((F.col("i") - F.col("lo") + 1) % F.col("n") + F.col("lo")).alias("i"))
    return asked.join(numbered.select("i", F.col("acc").alias("partner")), "i").filter("acc <> partner").select("acc", "partner")


@query(f"with {PARTNER} select acc, partner from pn")
def null_shuffle_same_class(spark, d):
    return _partners(spark, d)


@query(r"""with p as (select pid, count(*) as n from compound_predictions where pid is not null group by pid)
select surechembl_id, n from (select surechembl_id, try_cast(regexp_extract(surechembl_id, '^SCHEMBL([0-9]{1,18})$', 1) as bigint) as pid from patent_compounds) join p using (pid)""")
def numbered_id_join(spark, d):
    n = table(spark, d, "compound_predictions").filter("pid is not null").groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    t = table(spark, d, "patent_compounds").select("surechembl_id", R.numbered(F.col("surechembl_id")).alias("pid"))
    return t.join(n, "pid").select("surechembl_id", "n")


@query("""with e as (select distinct l_partkey, l_suppkey from lineitem), c as (select * from e qualify row_number() over (partition by l_partkey order by l_suppkey) <= 3)
select p_brand, n_name, count(*) as n from c join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by all""")
def chain_with_cap(spark, d):
    """A chain of joins whose first hop follows at most three edges of each row."""
    edges = transfer.rank_within(table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey", F.col("l_suppkey")).filter("rk <= 3")
    place = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return edges.join(place, "l_suppkey").join(parts, "l_partkey").groupBy("p_brand", "n_name").agg(F.count(F.lit(1)).alias("n"))


# ---- measures -----------------------------------------------------------------------------------------------------------

_PER_ACC = f"{LATEST}, {TRUTH}, g as (select acc, count(*) as n, count(tv.acc) as k from pr left join tv using (pid, acc) group by acc)"


def _hits_per_acc(spark, d, pairs: DataFrame) -> DataFrame:
    known = _truth(spark, d).withColumn("hit", F.lit(1))
    return pairs.join(known, ["pid", "acc"], "left").groupBy("acc").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k"))


@query(f"""with {_PER_ACC} select round(sum(k)::double / sum(n), 6) as micro, round(avg(k::double / n) filter (where n >= 3), 6) as macro, count(*) filter (where n >= 3) as n_groups, round(count(*) filter (where k > 0)::double / count(*), 6) as surfaced from g""")
def landscape_precision(spark, d):
    """Precision over all predictions, its mean over groups of at least three, and the share of groups with any hit."""
    g, big = _hits_per_acc(spark, d, _latest(spark, d)), F.col("n") >= 3
    return g.agg(F.round(F.sum("k") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.when(big, F.col("k") / F.col("n"))), 6).alias("macro"), F.count_if(big).alias("n_groups"), F.round(F.count_if(F.col("k") > 0) / F.count(F.lit(1)), 6).alias("surfaced"))


@query(f"""with {_PER_ACC}, {PARTNER}, v2 as (select tv.pid, pn.acc from tv join pn on pn.partner = tv.acc), z as (select acc, count(v2.acc) as k0 from pr left join v2 using (pid, acc) group by acc),
rk as (select acc, row_number() over (partition by pid order by confidence desc, acc) as r from pr), m as (select acc, list_sort(list(r))[greatest(1, ceil(0.5::double * count(*)))::bigint] as median_rank from rk group by acc)
select acc, n, round(k::double / n, 6) as precision, round(k0::double / n, 6) as chance, case when k0 > 0 then round(k::double / k0, 6) end as lift, k < k0 as disagree, median_rank from g join z using (acc) join m using (acc)""")
def text_precision(spark, d):
    """Per target the precision of its predictions, that of another target of its class in its place, their quotient, and
    the median place that the target has in the rankings of its compounds."""
    p = cut(_latest(spark, d))
    partners = _partners(spark, d).toDF("own", "acc")
    shifted = _truth(spark, d).join(partners, "acc").select("pid", F.col("own").alias("acc")).distinct().withColumn("hit", F.lit(1))
    null = p.join(shifted, ["pid", "acc"], "left").groupBy("acc").agg(F.count("hit").alias("k0"))
    ranked = transfer.rank_within(p, "pid", F.col("confidence").desc(), F.col("acc")).select("acc", F.col("rk").cast("double").alias("rk"))
    median = exact_quantiles(ranked, "acc", "rk", [0.5]).select("acc", F.col("q0").cast("bigint").alias("median_rank"))
    out = _hits_per_acc(spark, d, p).join(null, "acc").join(median, "acc")
    lift = F.when(F.col("k0") > 0, F.round(F.col("k") / F.col("k0"), 6))
    return out.select("acc", "n", F.round(F.col("k") / F.col("n"), 6).alias("precision"), F.round(F.col("k0") / F.col("n"), 6).alias("chance"), lift.alias("lift"), (F.col("k") < F.col("k0")).alias("disagree"), "median_rank")


@query(f"with {LATEST}, s as (select seed, avg(confidence) as m from pr, range(1, 6) t(seed) where substr(md5(seed::varchar || ':' || pid::varchar), 1, 1) in ('0', '1', '2', '3') group by seed) select count(*) as n_seeds, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd from s")
def seed_mean_sd(spark, d):
    """Mean and sample deviation of a measure over five seeded samples; sampling is the feature."""
    t = _latest(spark, d).select("pid", "confidence", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seed"))
    drawn = t.filter(F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("pid").cast("string"))), 1, 1).isin("0", "1", "2", "3"))
    per = drawn.groupBy("seed").agg(F.avg("confidence").alias("m"))
    return per.agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"))


_HITS = EVAL[: EVAL.index("select count(*) as n_queries")].rstrip()


def _loo_ranked(spark, d):
    c = table(spark, d, "chembl").filter("fp is not null").select("cid", "fp")
    asked, labels = c.filter("cid % 50 = 0"), _labels(spark, d)
    near = cut(simjoin.nearest(asked, c, 20, 0.3, others=True, below=0.99))
    truth = labels.withColumnRenamed("rid", "qid").join(asked.select(F.col("cid").alias("qid")), "qid")
    return near, transfer.transfer_labels(near, labels), truth


_BEST = "(select qid, max(sim) as best from nb group by qid)"


@query(f"""with {LOO}, ok as (select * from pk where qid <> rid and sim < 0.99), {_HITS} select case when best >= 0.5 then 'HIGH' when best >= 0.4 then 'MODERATE' when best >= 0.3 then 'LOW' else 'NOVEL' end as band, count(*) as n,
round(avg(case when hit_at <= 1 then 1.0::double else 0 end), 6) as recall_1, round(avg(case when hit_at <= 10 then 1.0::double else 0 end), 6) as recall_10 from hit left join {_BEST} b using (qid) group by 1""")
def recall_by_band(spark, d):
    near, ranked, truth = _loo_ranked(spark, d)
    hits = truth.join(ranked, ["qid", "label"], "left").groupBy("qid").agg(F.min("rk").alias("at")).join(near.groupBy("qid").agg(F.max("sim").alias("best")), "qid", "left")
    share = lambda k: F.round(F.avg(F.when(F.col("at") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return hits.groupBy(scores.confidence_band(F.col("best")).alias("band")).agg(F.count(F.lit(1)).alias("n"), share(1), share(10))


@query(f"with {LOO}, ok as (select * from pk where qid <> rid and sim < 0.99), {_HITS} select count(*) as n, round(avg(coalesce(1.0::double / hit_at, 0)), 6) as mrr, count(hit_at) as n_found from hit")
def mean_reciprocal_rank(spark, d):
    _near, ranked, truth = _loo_ranked(spark, d)
    hits = truth.join(ranked, ["qid", "label"], "left").groupBy("qid").agg(F.min("rk").alias("at"))
    return hits.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(1 / F.col("at"), F.lit(0.0))), 6).alias("mrr"), F.count("at").alias("n_found"))


@query(f"""with {LOO}, ok as (select * from pk where qid <> rid and sim < 0.99), {_HITS}, pop as (select label, row_number() over (order by count(*) desc, label) as rk from lab group by label qualify rk <= 50),
tr as (select rid as qid, label from lab where rid in (select qid from q)), m as (select 'neighbours' as method, tr.qid, count(p.label)::double / count(*) as r from tr left join pred p on p.qid = tr.qid and p.label = tr.label and p.rk <= 50 group by tr.qid
union all select 'popularity', tr.qid, count(pop.label)::double / count(*) from tr left join pop using (label) group by tr.qid) select method, count(*) as n, round(avg(r), 6) as mean_recall, round(median(r), 6) as median_recall from m group by method""")
def recall_by_method(spark, d):
    """Recall at 50 of the label transfer and of always naming the most frequent labels; the mean and the median over
    queries, from the table of different recalls (as many as truths have sizes)."""
    _near, ranked, truth = _loo_ranked(spark, d)
    pop = _labels(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label").limit(50).select("label", F.lit(1).alias("hit"))
    own = ranked.filter("rk <= 50").select("qid", "label", F.lit(1).alias("hit"))
    recall = (F.count("hit") / F.count(F.lit(1))).alias("r")
    both = truth.join(own, ["qid", "label"], "left").groupBy("qid").agg(recall).withColumn("method", F.lit("neighbours"))
    both = both.unionByName(truth.join(pop, "label", "left").groupBy("qid").agg(recall).withColumn("method", F.lit("popularity")))
    per = both.groupBy("method", "r").agg(F.count(F.lit(1)).alias("m"))
    return per.groupBy("method").agg(F.sum("m").alias("n"), F.round(F.sum(F.col("r") * F.col("m")) / F.sum("m"), 6).alias("mean_recall"), F.round(F.percentile("r", 0.5, F.col("m")), 6).alias("median_recall"))


@query(f"""with {LAB}, q as (select cid as qid, fp from chembl where cid % 50 = 0 and 2005 + cid // 50 % 17 > 2012 and fp is not null), r as (select cid as rid, fp from chembl where 2005 + cid // 50 % 17 <= 2012 and fp is not null),
pairs as (select qid, rid, list_sum(list_transform(range(1, 33), lambda i: bit_count(q.fp[i] & r.fp[i]))) as s, list_sum(list_transform(range(1, 33), lambda i: bit_count(q.fp[i] | r.fp[i]))) as u from q cross join r),
ok as (select qid, rid, round(s::double / u, 12) as sim from pairs where u > 0 and round(s::double / u, 12) >= 0.3), {EVAL}""")
def temporal_recall_at_k(spark, d):
    """Only ligands up to a year vote for those after it."""
    year = (2005 + F.floor(F.col("cid") / 50) % 17).alias("year")
    c = table(spark, d, "chembl").filter("fp is not null").select("cid", "fp", year)
    asked, labels = c.filter("year > 2012 and cid % 50 = 0").select("cid", "fp"), _labels(spark, d)
    ranked = transfer.transfer_labels(simjoin.nearest(asked, c.filter("year <= 2012").select("cid", "fp"), 20, 0.3), labels)
    return evaluate.recall_at(ranked, labels.withColumnRenamed("rid", "qid").join(asked.select(F.col("cid").alias("qid")), "qid"))


@query(f"""with {COS}, nn as (select qid, rid, la, lb from cs qualify row_number() over (partition by qid order by sim desc, rid) <= 10), s as (select qid, least(10, count(*) filter (where la = lb)) as m from cs group by qid)
select round((select count(*) from nn where la = lb)::double / (select sum(m) from s), 6) as recall""")
def twilight_recall(spark, d):
    """Of the rows with the query's label, how many are among its ten nearest, as a share of what ten places can hold."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    mine, other = e.select(F.col("vec_id").alias("qid"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("rid"), F.col("label").alias("lb"))
    near = transfer.rank_within(_cosine(spark, d, 11).filter("qid <> rid").drop("rk"), "qid", F.col("sim").desc(), F.col("rid")).filter("rk <= 10")
    found = near.join(mine, "qid").join(other, "rid").agg(F.count_if(F.col("la") == F.col("lb")).alias("hits"))
    sizes = e.groupBy(F.col("label").alias("la")).agg((F.count(F.lit(1)) - 1).alias("n"))
    room = mine.filter("qid % 50 = 0").join(sizes, "la").agg(F.sum(F.least(F.lit(10), "n")).alias("room"))
    return found.join(room).select(F.round(F.col("hits") / F.col("room"), 6).alias("recall"))  # one row each


@query("""with p as (select distinct pid from compound_predictions where pid is not null), r as (select case when c.id is null then 'no compound' when smiles is null or smiles = '' then 'no smiles' when fp is null then 'no fingerprint' else 'kept' end as reason from p left join patent_compounds c on c.id = p.pid) select reason, count(*) as n from r group by reason""")
def drop_accounting(spark, d):
    c = table(spark, d, "patent_compounds").select(F.col("id").alias("pid"), F.lit(True).alias("there"), (F.col("smiles") != "").alias("text"), F.col("fp").isNotNull().alias("bits"))
    j = table(spark, d, "compound_predictions").select("pid").filter("pid is not null").distinct().join(c, "pid", "left")
    reason = F.when(F.col("there").isNull(), "no compound").when(~F.coalesce("text", F.lit(False)), "no smiles").when(~F.col("bits"), "no fingerprint").otherwise("kept")
    return j.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {COS}, top as (select qid, rid, sim from cs qualify row_number() over (partition by qid order by sim desc, rid) <= 20), f as (select qid, rid // 4 as doc, max(sim) as best, round(avg(sim), 6) as mean, round(sum(sim), 6) as total from top group by all)
select qid, doc, best, mean, total, row_number() over (partition by qid order by best desc, doc) as rk from f qualify rk <= 5""")
def chunk_fold(spark, d):
    """Four times as many chunks as documents wanted, folded to their documents by the best, mean and summed score."""
    near = transfer.rank_within(_cosine(spark, d, 21).filter("qid <> rid").drop("rk"), "qid", F.col("sim").desc(), F.col("rid")).filter("rk <= 20")
    folded = near.groupBy("qid", F.floor(F.col("rid") / 4).alias("doc")).agg(F.max("sim").alias("best"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.sum("sim"), 6).alias("total"))
    return transfer.rank_within(folded, "qid", F.col("best").desc(), F.col("doc")).filter("rk <= 5").select("qid", "doc", "best", "mean", "total", *_long("rk"))


@query("""with e as (select ts::date as day, event_type, user_id, coalesce(json_extract_string(props, '$.k'), 'none') as term, value from events), a as (select day, term, round(sum(value), 4) as total, min(user_id) as first_user from e group by all),
t as (select *, row_number() over (partition by day order by total desc, term) as rk from a qualify rk <= 5), s as (select day, count(distinct term) filter (where event_type = 'error') as error_terms, count(distinct term) filter (where event_type <> 'error') as other_terms, max(user_id) as at_risk from e group by day)
select day, error_terms, other_terms, at_risk, rk, term, first_user, round(100 * total / at_risk, 1) as pct from s join t using (day)""")
def event_report(spark, d):
    """Per day the different terms by kind, the number at risk, and the five heaviest terms with their first user."""
    e = table(spark, d, "events").select(F.col("ts").cast("date").alias("day"), "event_type", "user_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("term"), "value")
    per = e.groupBy("day", "term").agg(F.round(F.sum("value"), 4).alias("total"), F.min("user_id").alias("first_user"))
    top = transfer.rank_within(per, "day", F.col("total").desc(), F.col("term")).filter("rk <= 5")
    error = F.col("event_type") == "error"
    s = e.groupBy("day").agg(F.countDistinct(F.when(error, F.col("term"))).alias("error_terms"), F.countDistinct(F.when(~error, F.col("term"))).alias("other_terms"), F.max("user_id").alias("at_risk"))
    return s.join(top, "day").select("day", "error_terms", "other_terms", "at_risk", *_long("rk"), "term", "first_user", F.round(100 * F.col("total") / F.col("at_risk"), 1).alias("pct"))


@query(f"""with {LATEST}, {TRUTH}, h as (select pr.pid, coalesce(t.org, 'unknown') as class, case when tv.acc is not null then 1.0::double else 0 end as hit from pr join targets t using (acc) left join tv on tv.pid = pr.pid and tv.acc = pr.acc),
e as (select class, pid, max(hit) as hit from h group by class, pid) select 'pair' as grain, class, count(*) as n, round(avg(hit), 6) as recall from h group by class union all select 'compound', class, count(*), round(avg(hit), 6) from e group by class""")
def class_recall_grains(spark, d):
    """The share of hits by class, once over pairs and once over compounds with a pair of the class."""
    t = table(spark, d, "targets").select("acc", F.coalesce("org", F.lit("unknown")).alias("class"))
    h = _latest(spark, d).join(t, "acc").join(_truth(spark, d).withColumn("h", F.lit(1.0)), ["pid", "acc"], "left").select("pid", "class", F.coalesce("h", F.lit(0.0)).alias("hit"))
    report = lambda df, grain: df.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("recall")).withColumn("grain", F.lit(grain))
    return report(h, "pair").unionByName(report(h.groupBy("class", "pid").agg(F.max("hit").alias("hit")), "compound")).select("grain", "class", "n", "recall")


@query(f"""with {LATEST}, {TRUTH}, s as (select case when support = 1 and confidence < 0.4 then 'drop' else 'keep' end as side, tv.acc is not null as hit from pr left join tv using (pid, acc) where support is not null)
select side, count(*) as n, count(*) filter (where hit) as n_right, round(count(*) filter (where hit)::double / count(*), 6) as share_right, round(count(*) filter (where hit)::double / (select count(*) from s where hit), 6) as share_of_right from s group by side""")
def floor_correctness(spark, d):
    """What the floor drops: how much of it is right, and how much of all that is right."""
    s = _latest(spark, d).filter("support is not null").join(_truth(spark, d).withColumn("h", F.lit(1)), ["pid", "acc"], "left")
    per = s.groupBy(F.when((F.col("support") == 1) & (F.col("confidence") < 0.4), "drop").otherwise("keep").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.count("h").alias("n_right"))
    return per.select("side", "n", "n_right", F.round(F.col("n_right") / F.col("n"), 6).alias("share_right"), F.round(F.col("n_right") / F.sum("n_right").over(Window.partitionBy()), 6).alias("share_of_right"))  # two rows


# ---- rankings, orders and sets ---------------------------------------------------------------------------------------

_GENES = f"{LATEST}, rg as (select pid, upper(gene) as gene, row_number() over (partition by pid order by confidence desc, acc) as rk from pr left join targets using (acc)), fo as (select pid, gene, min(rk) as first_at from rg where gene is not null group by pid, gene)"


def _gene_ranks(spark, d) -> DataFrame:
    t = table(spark, d, "targets").select("acc", "gene")
    return transfer.rank_within(_latest(spark, d), "pid", F.col("confidence").desc(), F.col("acc")).join(t, "acc", "left")


@query(f"with {_GENES} select pid, gene as item, row_number() over (partition by pid order by first_at, gene) as rank from fo")
def genes_by_first_rank(spark, d):
    return first_occurrences(_gene_ranks(spark, d), "pid", F.upper("gene"), "rk")


@query(f"with {_GENES} select pid, gene as item, row_number() over (partition by pid order by first_at, gene) as rank from fo qualify rank <= 3")
def genes_capped(spark, d):
    return first_occurrences(_gene_ranks(spark, d), "pid", F.upper("gene"), "rk", 3)


@query("select doc_id, source, row_number() over (order by source nulls first, doc_id) - 1 as global_id from documents")
def global_numbers(spark, d):
    """Running numbers over the whole table in an order, no task seeing more than its part."""
    return running_number(table(spark, d, "documents").select("source", "doc_id"), ["source", "doc_id"], "global_id").select("doc_id", "source", "global_id")


@query("select b as batch, count(*) as n, max(n_chars) as longest from (select n_chars, (row_number() over (order by n_chars nulls first, doc_id) - 1) // 32 as b from documents) group by b")
def length_batches(spark, d):
    """Batches of 32 texts of like length."""
    t = running_number(table(spark, d, "documents").select("n_chars", "doc_id"), ["n_chars", "doc_id"])
    return t.groupBy(F.floor(F.col("number") / 32).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


@query("select id, surechembl_id from patent_compounds order by id limit 25 offset 50")
def offset_page(spark, d):
    return table(spark, d, "patent_compounds").select("id", "surechembl_id").orderBy("id").offset(50).limit(25)


@query("select surechembl_id from patent_compounds order by try_cast(substr(surechembl_id, 8) as bigint) desc, surechembl_id limit 30")
def numeric_id_order(spark, d):
    """Ids by their numbers, not as texts; the limit is the feature."""
    return table(spark, d, "patent_compounds").select("surechembl_id").orderBy(R.numbered(F.col("surechembl_id")).desc(), "surechembl_id").limit(30)


@query(f"select patent_number, array_to_string(list_filter(cpc, lambda x, i: list_position(cpc, x) = i), ';') as codes from {PAT} where cpc is not null")
def ordered_distinct(spark, d):
    """Repeats leave a list, the order stays."""
    return _newest(spark, d, "patents", "patent_number").filter("cpc is not null").select("patent_number", F.array_join(F.array_distinct("cpc"), ";").alias("codes"))


@query("select patent_number as id from patents where patent_number is not null union select upper(trim(unnest(pat_nums))) from validate_patent_text_support where pat_nums is not null")
def id_union(spark, d):
    a = table(spark, d, "patents").select(F.col("patent_number").alias("id")).filter("id is not null").distinct()
    b = table(spark, d, "validate_patent_text_support").select(F.explode("pat_nums").alias("x")).select(F.upper(F.trim("x")).alias("id"))
    return a.union(b).distinct()


@query(f"with {LATEST} select a.pid, string_agg(a.acc, ';' order by a.confidence desc, a.acc) as shared from pr a join pr b on b.pid = a.pid + 1 and b.acc = a.acc group by a.pid")
def shared_labels(spark, d):
    """Labels that a compound shares with the next one, in the order of its own confidence."""
    p = _latest(spark, d)
    both = p.join(p.select((F.col("pid") - 1).alias("pid"), "acc"), ["pid", "acc"])
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "acc")))
    return both.groupBy("pid").agg(F.array_join(F.transform(ordered, lambda x: x["acc"]), ";").alias("shared"))


@query(f"""with {NB}, {LAB}, tt as (select label, row_number() over (order by label) - 1 as i, count(*) over () as n from (select distinct label from lab)), g as (select qid, k, ('0x' || substr(md5(qid::varchar || ':' || k::varchar), 1, 15))::bigint as h from q, range(1, 4) t(k))
select qid, k as rk, label from g join tt on i = h % n""")
def random_baseline(spark, d):
    """Three labels for every query by a seeded hash: what a ranking has to beat."""
    labels = cut(running_number(_labels(spark, d).select("label").distinct(), ["label"], "i"))
    n = labels.count()
    asked = _queries(spark, d).select("qid", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    h = F.conv(F.substring(F.md5(F.concat(F.col("qid").cast("string"), F.lit(":"), F.col("k").cast("string"))), 1, 15), 16, 10).cast("bigint")
    return asked.withColumn("i", h % max(n, 1)).join(labels, "i").select("qid", F.col("k").cast("bigint").alias("rk"), "label")


# ---- expressions --------------------------------------------------------------------------------------------------------


@query("select acc, trim(concat_ws(' ', gene, trim(split_part(target_name, '(', 1)))) as query_text from targets")
def query_texts(spark, d):
    return table(spark, d, "targets").select("acc", R.query_text(F.col("gene"), F.coalesce("target_name", F.lit(""))).alias("query_text"))


@query(f"select patent_number, md5(case when length(c) > 2000 then substr(c, 1, 2000) || '...' else c end) as claims_md5, md5(case when length(description) > 1000 then substr(description, 1, 1000) || '...' else description end) as short_md5 from (select patent_number, description, array_to_string(string_split(description, chr(10))[1:3], ' ') as c from {PAT} where description is not null)")
def shortened_claims(spark, d):
    t = _newest(spark, d, "patents", "patent_number").filter("description is not null")
    return t.select("patent_number", F.md5(R.first_claims(F.split("description", "\n"))).alias("claims_md5"), F.md5(R.shortened(F.col("description"), 1000)).alias("short_md5"))


# class paths that targets are given by the hash of their accession
_PATHS = [f"protein class{p}" for p in ("/Enzyme/Kinase/Protein Kinase", "/Enzyme/Protease", "/Membrane receptor/Family A G protein-coupled receptor", "/Ion channel/Ligand-gated", "/Transcription factor/Nuclear receptor", "/Transporter/Electrochemical", "/Epigenetic regulator/Eraser", "/Membrane receptor", "/Enzyme/Hydrolase", "/Transcription factor", "/Adhesion", "/Unclassified protein")]
_PATH_SQL = "[" + ", ".join(f"'{p}'" for p in _PATHS) + "]"
_FAMILY = f"""pth as (select acc, gene, case when length(acc) % 2 = 1 then '' else array_to_string([{_PATH_SQL}[h % 12 + 1], {_PATH_SQL}[h % 5 + 1]], ' ;; ') end as p from (select acc, gene, ('0x' || substr(md5(acc), 1, 8))::bigint as h from targets)),
fam as (select acc, gene, case """ + " ".join(f"when contains(p, '{part}') then {i}" for i, (part, _n) in enumerate(R.FAMILIES)) + f" when p <> '' and not contains(p, 'Unclassified') then {len(R.FAMILIES)} else {len(R.FAMILIES) + 1} end as place from pth), nm as (select [" + ", ".join(f"'{n}'" for n in [*(n for _p, n in R.FAMILIES), R.CLASSIFIED, R.UNCLASSIFIED]) + "] as names)"


def _families(spark, d) -> DataFrame:
    h = F.conv(F.substring(F.md5("acc"), 1, 8), 16, 10).cast("bigint")
    pick = lambda n: F.element_at(F.array(*map(F.lit, _PATHS)), (h % n + 1).cast("int"))
    paths = F.when(F.length("acc") % 2 == 0, F.array(pick(12), pick(5)))
    return table(spark, d, "targets").select("acc", "gene", R.family_place(paths).alias("place"))


@query(f"with {_FAMILY} select acc, names[place + 1] as family from fam, nm")
def protein_family(spark, d):
    return _families(spark, d).select("acc", R.family_name(F.col("place")).alias("family"))


@query(f"with {_FAMILY} select gene, names[min(place) + 1] as family from fam, nm where gene is not null group by gene, names")
def class_priority(spark, d):
    """One family a gene, the first in their order among its targets."""
    return _families(spark, d).filter("gene is not null").groupBy("gene").agg(R.family_name(F.min("place")).alias("family"))


@query("select id, case id % 3 when 0 then 'What does ' || surechembl_id || ' bind?' when 1 then 'Which patents name ' || surechembl_id || '?' else 'What resembles ' || surechembl_id || '?' end as question from patent_compounds")
def question_templates(spark, d):
    templates = ["What does {} bind?", "Which patents name {}?", "What resembles {}?"]
    return table(spark, d, "patent_compounds").select("id", R.turned(templates, F.col("id"), F.col("surechembl_id")).alias("question"))


@query("select o_orderkey, o_orderdate::date as day from orders")
def file_dates(spark, d):
    """Dates out of the names of files."""
    name = F.concat(F.lit("I"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-SUPP_r2.ZIP"))
    return table(spark, d, "orders").select("o_orderkey", R.compact_date(name).alias("day"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ';' || strftime(o_orderdate + interval 30 day, '%Y-%m-%d') as days from orders")
def nested_dates(spark, d):
    """All dates of a nested JSON text, wherever they stand."""
    a, b = F.date_format("o_orderdate", "yyyyMMdd"), F.date_format(F.date_add("o_orderdate", 30), "yyyyMMdd")
    text = F.to_json(F.struct(F.struct(b.alias("date"), F.lit("12345678x").alias("no")).alias("doc"), F.array(F.struct(a.alias("d")), F.struct(b.alias("d"))).alias("rest")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(R.all_dates(text).cast("array<string>"), ";").alias("days"))


_SHA63 = "(('0x' || substr(sha256({0}), 1, 16))::ubigint & 9223372036854775807)::bigint"


@query(f"""select doc_id, {_SHA63.format("case when origin_key like 'NCT%' then 'nct:' || origin_key when origin_key is not null then 'patent:' || origin_key else 'doc:' || doc_id::varchar end")} as point_id from documents""")
def prioritised_ids(spark, d):
    """An id from the first key that a row has."""
    nct = F.when(F.col("origin_key").startswith("NCT"), F.col("origin_key"))
    return table(spark, d, "documents").select("doc_id", R.first_id(nct=nct, patent=F.col("origin_key"), doc=F.col("doc_id")).alias("point_id"))


@query(f"select patent_number, sha256(coalesce(title, '') || coalesce(country, '') || coalesce(array_to_string(list_sort(cpc), '|'), '') || coalesce(array_to_string(list_sort(ipc), '|'), '')) as h from {PAT}")
def patent_hash(spark, d):
    """A content hash in which the order of a list makes no difference."""
    t = _newest(spark, d, "patents", "patent_number")
    return t.select("patent_number", R.list_hash(F.col("title"), F.col("country"), (F.col("cpc"),), (F.col("ipc"),)).alias("h"))


@query("select doc_id, md5(substr(text, 1, 500)) as cut_md5, length(text) > 500 as was_cut from documents where text is not null")
def truncated_results(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", F.md5(R.shortened(F.col("text"), 500, "")).alias("cut_md5"), (F.length("text") > 500).alias("was_cut"))


@query("select p_partkey, case when p_size % 7 = 0 then null else p_size end as whole, case when p_size % 7 = 0 then '' else p_size::varchar end as plain from part")
def coerced_numbers(spark, d):
    """'12.0' as 12 and '12', 'nan' as null and ''."""
    raw = F.when(F.col("p_size") % 7 == 0, "nan").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    t = table(spark, d, "part").select("p_partkey", raw.alias("raw"), (F.col("p_size") % 7 == 0).alias("none"))
    return t.select("p_partkey", F.when(~F.col("none"), R.whole_number(F.col("raw"))).cast("int").alias("whole"), R.plain_number_text(F.col("raw")).alias("plain"))


@query("select acc, round(1 - levenshtein(acc, gene)::double / greatest(length(acc), length(gene)), 6) as identity from targets where gene is not null and gene <> ''")
def edit_identity(spark, d):
    return table(spark, d, "targets").filter("gene <> ''").select("acc", F.round(R.identity(F.col("acc"), F.col("gene")), 6).alias("identity"))


@query("""select user_id, round(ln(sum(exp(value / 10)) filter (where event_type = 'click')) - ln(sum(exp(value / 10)) filter (where event_type = 'view')), 6) as ratio from events group by user_id
having count(*) filter (where event_type = 'click') > 0 and count(*) filter (where event_type = 'view') > 0""")
def log_ratio(spark, d):
    """The logarithm of the quotient of two sums of exponentials, taken stably."""
    e = table(spark, d, "events").filter("event_type in ('click', 'view') and value is not null")
    per = e.groupBy("user_id", "event_type").agg(R.log_sum_exp(F.col("value") / 10).alias("x"))
    both = per.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("x"))).alias("a"), F.max(F.when(F.col("event_type") == "view", F.col("x"))).alias("b"))
    return both.filter("a is not null and b is not null").select("user_id", F.round(F.col("a") - F.col("b"), 6).alias("ratio"))


@query("select vec_id, j as pos, round(list_sum(list_transform(range(1, 7), lambda k: embedding[k * 8 + j + 1]::double)) / 6, 5) as mean from embeddings, range(0, 8) t(j)")
def mean_pooled(spark, d):
    """Eight token vectors in one row, pooled without the first and last."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(R.mean_pool(tokens, 8)).alias("pos", "x")).select("vec_id", *_long("pos"), F.round("x", 5).alias("mean"))


@query("""with s as (select acc, md5(acc) as s from targets), g as (select acc, string_split(s, '') || list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) as g from s),
c as (select acc, list_transform(['a', 'b', 'aa', 'ab', 'ba', 'bb'], lambda k: len(list_filter(g, lambda x: x = k))::double) as c from g), m as (select acc, list_transform(c, lambda x: x - list_sum(c) / 6) as m from c)
select acc, i - 1 as pos, round(case when list_sum(list_transform(m, lambda y: y * y)) > 0 then m[i] / sqrt(list_sum(list_transform(m, lambda y: y * y))) else m[i] end, 6) + 0.0::double as v from m, range(1, 7) t(i)""")
def kmer_vectors(spark, d):
    return table(spark, d, "targets").select("acc", F.posexplode(R.kmer_counts(F.md5("acc"), "ab")).alias("pos", "x")).select("acc", *_long("pos"), (F.round("x", 6) + F.lit(0.0)).alias("v"))


@query("select doc_id, i as pos, len(list_filter(w, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % 16 = i))::double as v from range(0, 16) t(i), (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') as w from documents)")
def word_vectors(spark, d):
    """A stand-in for a text encoder: counts of words by hash."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(R.word_vector(F.col("text"), 16)).alias("pos", "v")).select("doc_id", *_long("pos"), "v")


# ---- texts beside predictions -----------------------------------------------------------------------------------------

# Document and target vectors: rows of embeddings, taken by the number of the patent and of the target.
SUPPORT = """ne as (select count(*) as n from embeddings), dv as (select patent_number as doc, pd.id, pd.date, embedding as v from (select patent_number, id, max(publication_date) as date from patents where release_version = (select max(release_version) from patents) and description is not null group by patent_number, id) pd, ne join embeddings on vec_id = pd.id % ne.n),
tx as (select acc, embedding as v from (select acc, row_number() over (order by acc) - 1 as i from targets), ne join embeddings on vec_id = (i * 13 + 5) % ne.n),
it as (select distinct cid, upper(trim(p)) as doc from (select cid, unnest(pat_nums) as p from validate_patent_text_support where cid % 50 = 0) where trim(p) <> ''),
quiet as (select cid from it group by cid having count(*) <= 40), ld as (select cid, doc from (select it.*, row_number() over (partition by cid order by date desc nulls last, doc) as rn from it join quiet using (cid) join dv using (doc)) where rn <= 50),
want as (select cid, acc, max(conf) as conf from (select cid, upper(trim(a)) as acc, c as conf from (select cid, unnest(pred_accs) as a, unnest(pred_confs) as c from validate_patent_text_support where cid % 50 = 0)) where acc in (select acc from tx) group by cid, acc),
sim as (select dv.doc, tx.acc, round(list_dot_product(dv.v::double[], tx.v::double[]), 6) as s from (select * from dv where doc in (select doc from ld)) dv cross join tx), bg as (select acc, sum(round(s * 1000000)::bigint)::double / count(*) / 1000000 as b from (select tx.acc, round(list_dot_product(e.embedding::double[], tx.v::double[]), 6) as s from embeddings e cross join tx where e.vec_id % 50 = 0) group by acc),
rnk as (select doc, acc, row_number() over (partition by doc order by round(s - b, 6) desc, acc) as rk from sim join bg using (acc))"""


def _text_vectors(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All vectors (vec_id, v), those of patents with full text (doc, date, v) and those of targets (acc, v)."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    n = e.count()
    p = table(spark, d, "patents")
    newest = p.agg(F.max("release_version")).first()[0]
    full = p.filter((F.col("release_version") == F.lit(newest)) & F.col("description").isNotNull()).groupBy(F.col("patent_number").alias("doc"), "id").agg(F.max("publication_date").alias("date"))
    docs = full.withColumn("vec_id", F.col("id") % n).join(e, "vec_id").select("doc", "id", "date", "v")
    targets = running_number(table(spark, d, "targets").select("acc"), ["acc"], "i").withColumn("vec_id", (F.col("i") * 13 + 5) % n).join(e, "vec_id").select("acc", "v")
    return e, docs, targets


def _biased(e: DataFrame, targets: DataFrame) -> DataFrame:
    """(acc, v, mean): targets with their mean product with the texts of the background."""
    background = e.filter("vec_id % 50 = 0").select(F.concat(F.lit("#"), F.col("vec_id").cast("string")).alias("id"), "v")
    bias = simjoin.mean_similarity(background, targets, measure="dot", digits=6)
    return targets.join(bias.withColumnRenamed("rid", "acc"), "acc").select("acc", "v", "mean")


@query(f"with {SUPPORT.replace('where doc in (select doc from ld)', 'where id % 50 = 0')} select doc, acc, rk from rnk where rk <= 3")
def top_targets_per_text(spark, d):
    """The three best targets of all for each text of the stated set, ids divisible by 50."""
    e, docs, targets = _text_vectors(spark, d)
    asked = docs.filter("id % 50 = 0").select("doc", "v")
    near = simjoin.nearest(asked, _biased(e, targets), 3, floor=-1e300, measure="dot", digits=6, less="mean")
    return near.select(F.col("qid").alias("doc"), F.col("rid").alias("acc"), *_long("rk"))


@query(f"""with {SUPPORT} select want.cid, want.acc, min(rk) as best_rank, case when min(rk) <= 10 and max(conf) >= 0.5 then 'confirms' when min(rk) > 50 then 'suggests_other' else 'weak' end as verdict
from want join ld using (cid) join rnk using (doc, acc) group by want.cid, want.acc""")
def patent_text_support(spark, d):
    """Per compound and predicted target the best place that the target has among all targets in any of the compound's
    newest fifty patents with full text, by the vectors' inner product less the target's mean over other texts. Compounds
    with more than forty patents say nothing and are left out."""
    e, docs, targets = _text_vectors(spark, d)
    t = table(spark, d, "validate_patent_text_support").filter("cid % 50 = 0")  # the stated set of queries
    items = t.select("cid", F.explode("pat_nums").alias("x")).select("cid", F.upper(F.trim("x")).alias("doc")).filter("doc <> ''").distinct()
    quiet = items.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).filter("n <= 40").select("cid")
    linked = cut(transfer.rank_within(items.join(quiet, "cid").join(docs.select("doc", "date"), "doc"), "cid", F.col("date").desc_nulls_last(), F.col("doc")).filter("rk <= 50").select("cid", "doc"))
    want = t.select("cid", F.explode(F.arrays_zip("pred_accs", "pred_confs")).alias("x")).select("cid", F.upper(F.trim("x.pred_accs")).alias("acc"), F.col("x.pred_confs").alias("conf"))
    want = want.filter("acc <> ''").groupBy("cid", "acc").agg(F.max("conf").alias("conf")).join(targets.select("acc"), "acc", "left_semi")
    asked = linked.join(want, "cid").select("doc", "acc").distinct()
    ranks = simjoin.ranks_of(docs.select("doc", "v"), _biased(e, targets), asked, measure="dot", digits=6, less="mean")
    best = want.join(linked, "cid").join(ranks.toDF("doc", "acc", "rk"), ["doc", "acc"]).groupBy("cid", "acc").agg(F.min("rk").alias("best_rank"), F.max("conf").alias("conf"))
    verdict = F.when((F.col("best_rank") <= 10) & (F.col("conf") >= 0.5), "confirms").when(F.col("best_rank") > 50, "suggests_other").otherwise("weak")
    return best.select("cid", "acc", "best_rank", verdict.alias("verdict"))


@query(f"""with {LATEST}, {NB}, bs as (select qid, max(sim) as best from nb group by qid), tp as (select pid, arg_max(acc, (confidence, acc)) as acc, count(*) as n from pr group by pid), lk as (select item, count(*) as n from (select distinct cid as item, upper(trim(unnest(pat_nums))) as r from validate_patent_text_support where cid is not null) where r is not null group by item)
select q.qid, tp.acc, coalesce(t.gene, '') as gene, coalesce(tp.n, 0) as n_predictions, coalesce(lk.n, 0) as n_patents, coalesce(best, 0.0) as best from q left join tp on tp.pid = q.qid left join targets t on t.acc = tp.acc left join lk on lk.item = q.qid left join bs using (qid)""")
def dossier(spark, d):
    """What all tables say about a compound, in one row."""
    top = _latest(spark, d).groupBy(F.col("pid").alias("qid")).agg(F.max_by("acc", F.struct("confidence", "acc")).alias("acc"), F.count(F.lit(1)).alias("n_predictions"))
    links = table(spark, d, "validate_patent_text_support").filter("cid is not null").select(F.col("cid").alias("qid"), F.explode("pat_nums").alias("x")).select("qid", F.upper(F.trim("x")).alias("x")).filter("x is not null").distinct()
    n_patents = links.groupBy("qid").agg(F.count(F.lit(1)).alias("n_patents"))
    best = transfer.best_and_flags(_queries(spark, d).select("qid"), _neighbours(spark, d)).select("qid", "best")
    genes = table(spark, d, "targets").select("acc", "gene")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return best.join(top, "qid", "left").join(n_patents, "qid", "left").join(genes, "acc", "left").select("qid", "acc", F.coalesce("gene", F.lit("")).alias("gene"), zero("n_predictions"), zero("n_patents"), "best")
