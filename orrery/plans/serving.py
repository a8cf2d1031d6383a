"""Queries through the engine's read side, and runs that go on where they were broken off."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orrery.engine import Collection, Engine
from orrery.operators import state
from orrery.operators.provenance import contiguous_groups
from orrery.plans.library import LAB, LINK, _labels, _links, _long, _records
from orrery.session import shared_folder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _engine(spark: SparkSession, d: str) -> Engine:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("body"))
    ligands = table(spark, d, "chembl").filter("fp is not null").select(F.col("cid").alias("id"), F.col("fp").alias("vector"), "smiles", F.array((F.col("cid") % 7).cast("string"), (F.col("cid") % 5).cast("string")).alias("groups"))
    targets = table(spark, d, "targets").select(F.col("acc").alias("label"), "gene", F.col("target_name").alias("name"), "org")
    return Engine(spark, {"texts": Collection(vectors, "text", 64), "ligands": Collection(ligands, "chemical")}, _labels(spark, d), targets)


_SIM7 = "s as (select e.vec_id as id, e.label, round(list_dot_product(q.embedding::double[], e.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))), 9) as score from embeddings e, (select embedding from embeddings where vec_id = 7) q)"


@query(f"with {_SIM7} select id, label, round(score, 4) as score from s where label in (1, 2, 3) order by score desc, id limit 5 offset 2")
def engine_search_page(spark, d):
    """The second page of the rows most similar to a stored one, under a filter, without the text that was embedded."""
    out = _engine(spark, d).query("texts", like=7, filter={"label": [1, 2, 3]}, limit=5, offset=2)
    return out.drop("body").select("id", "label", "score")


@query("select vec_id as id, label from embeddings where vec_id in (3, 14, 15)")
def engine_by_ids(spark, d):
    """Ids win over everything else that is asked; numbers may come as texts."""
    return _engine(spark, d).query("texts", ids=["3", 14, "15"], like=7, limit=1).select("id", "label")


@query("select vec_id as id, label from embeddings where vec_id > 100 and label >= 2 order by vec_id limit 100")
def engine_scroll(spark, d):
    """A cursor page; limits are kept within 1 and 100."""
    return _engine(spark, d).query("texts", after=100, filter={"label": {"gte": 2}}, limit=10_000).select("id", "label")


@query("select count(*) as n from embeddings where label >= 2 and label <= 3")
def engine_count(spark, d):
    return spark.createDataFrame([(_engine(spark, d).count("texts", filter={"label": {"gte": 2, "lte": 3}}),)], "n bigint")


_LIG = """q as (select min(cid) as qid from chembl where fp is not null), x as (select cid as rid, c.fp, y.fp as qfp from chembl c, (select fp from chembl, q where cid = qid) y where c.fp is not null),
p as (select rid, list_sum(list_transform(range(1, 33), lambda i: bit_count(fp[i] & qfp[i]))) as s, list_sum(list_transform(range(1, 33), lambda i: bit_count(fp[i] | qfp[i]))) as u from x),
nb as (select rid, round(s::double / u, 12) as sim, row_number() over (order by round(s::double / u, 12) desc, rid) as rk from p where u > 0)"""


@query(f"""with {_LIG}, {LAB}, sc as (select label, max(sim) as conf, count(*) as support, round(sum(sim), 6) as vote from nb join lab using (rid) where rk <= 20 and sim >= 0.3 group by label),
k as (select min(label) as label from sc where conf < 0.6), r as (select sc.label, gene, conf, support, sc.label in (select label from k) as known, row_number() over (order by conf desc, support desc, vote desc, sc.label) as rk from sc join targets on acc = sc.label where org is null or org like '%Homo sapiens%')
select label, gene, round(conf, 3) as conf, support, known from (select *, row_number() over (order by rk) as place from r where conf >= 0.6 or known) where place <= 20""")
def engine_predict_known(spark, d):
    """A prediction with a floor, below which a label known for the compound stays."""
    e = _engine(spark, d)
    row = e._collection("ligands").rows.orderBy("id").first()
    below = e.predict("ligands", vector=list(row.vector), top=100, human_only=False).filter("conf < 0.6D").agg(F.min("label")).first()[0]
    out = e.predict("ligands", vector=list(row.vector), top=20, floor=0.6, known=[below] if below else [])
    return out.select("label", "gene", "conf", *_long("support"), "known")


@query(f"""with {_LIG} select rid as id, round(sim, 4) as score, array_to_string(list_filter([(q.qid % 7)::varchar, (q.qid % 5)::varchar], lambda g: list_contains([(rid % 7)::varchar, (rid % 5)::varchar], g)), ';') as shared from nb, q where rid <> q.qid order by rk limit 8""")
def engine_similar(spark, d):
    """The nearest rows of a stored one, with what they share with it, in its own order."""
    e = _engine(spark, d)
    first = e._collection("ligands").rows.agg(F.min("id")).first()[0]
    return e.similar("ligands", id=first, limit=8, labels="groups").select("id", "score", F.array_join("shared", ";").alias("shared"))


@query("select count(*) as n_rows, sum(id)::bigint as id_sum, true as resumed from patent_compounds")
def resume_by_key(spark, d):
    """A run over batches by key that breaks off in its second one, and the run that goes on behind the first."""
    path = f"{shared_folder(spark)}/resume-{uuid.uuid4().hex}"
    t, calls = table(spark, d, "patent_compounds").select("id"), []

    def write(rows):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("store is away")
        rows.write.mode("append").parquet(f"{path}/out")

    size = max(1, t.count() // 4)
    try:
        state.process_from(t, "id", size, f"{path}/state", write)
    except OSError:
        pass
    again = state.process_from(t, "id", size, f"{path}/state", write)
    out = spark.read.parquet(f"{path}/out")
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("id_sum")).withColumn("resumed", F.lit(len(calls) == again + 2))


@query(f"with {LINK} select item, count(*) as n, min(date) as first, max(date) as last from lk left join rec using (record) group by item")
def contiguous_link_counts(spark, d):
    """Links of every item, streamed by in order with the state of one item."""
    return contiguous_groups(_links(spark, d).join(_records(spark, d), "record", "left"), "item", "date")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def stream_upserts(spark, d):
    """A stream of events into a store that holds each user's newest one, which a second run finds done."""
    from orrery.streaming.incremental import current_rows, events_stream, upsert_batches

    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    for _run in range(2):
        stream = events_stream(spark, d).filter("user_id is not null").select("user_id", "event_id", "event_type", "value")
        upsert_batches(stream, "user_id", "event_id", f"{path}/rows", f"{path}/checkpoint", 8).awaitTermination()
    return current_rows(spark, f"{path}/rows").select("user_id", "event_id", "event_type", "value")
