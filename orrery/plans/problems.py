"""Queries of the general problems (hot keys, top N, snapshot changes) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.hotkeys import exact_quantiles, select_ranks
from orrery.operators.snapshots import snapshot_changes
from orrery.operators.topn import graded_bin, latest_rows, top_n_per_group
from orrery.session import table


def _named_keys(t: DataFrame, field: str) -> DataFrame:
    key = F.upper(F.trim("raw"))
    return t.select("cid", F.explode(field).alias("raw")).select("cid", F.lit(field).alias("field_name"), key.alias("key_value")).filter("key_value <> ''")


def p4_found(spark: SparkSession, sf_dir: str, percent: int = 5) -> DataFrame:
    """A key is named by so many cids exactly if the selection finds its cid of that rank among its different ones."""
    t = table(spark, sf_dir, "validate_patent_text_support")
    named = _named_keys(t, "pat_nums").unionByName(_named_keys(t, "pred_accs"))
    total = t.select("cid").distinct().agg(F.count("cid")).first()[0]
    rank = max(1, -(-percent * total // 100))
    found = select_ranks(named, ["field_name", "key_value"], "cid", F.array(F.lit(rank).cast("bigint")), distinct=True, least=rank)
    return found.select("field_name", "key_value")


def p4_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per accession the exact median and ninth decile of its confidences, over all rows as delivered."""
    t = table(spark, sf_dir, "validate_patent_text_support")
    pairs = t.select(F.explode(F.arrays_zip("pred_accs", "pred_confs")).alias("x")).select(F.upper(F.trim("x.pred_accs")).alias("acc"), F.col("x.pred_confs").alias("conf"))
    out = exact_quantiles(pairs.filter("acc <> ''"), "acc", "conf", [0.5, 0.9])
    return out.select("acc", F.col("n").alias("n_rows"), F.col("q0").alias("median_conf"), F.col("q1").alias("p90_conf"))


def p5_found(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    t = table(spark, sf_dir, "compound_predictions").filter("acc is not null and pid is not null")
    latest = latest_rows(t, ["acc", "pid"], "scored_at", ["support", "confidence"])
    ranked = latest.filter("support is not null and confidence is not null and not isnan(confidence)")
    order = [F.col("support").desc(), F.col("confidence").desc(), F.col("pid").asc()]
    cells = graded_bin([(F.col("support"), 0, 32, 32), (F.col("confidence"), 0.0, 1.0, 64)])
    return top_n_per_group(ranked, ["acc"], order, n, cells, F.col("pid")).select("acc", "pid")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, key in (("patents", "patent_number"), ("trials", "nct_id")):
        changes = snapshot_changes(table(spark, sf_dir, name), key, "release_version", "loaded_at")
        out.append(changes.select(F.lit(name).alias("table_name"), F.col(key).alias("record_key"), "release_version", "change_kind"))
    return out[0].unionByName(out[1])


QUERIES = {"p4_found": p4_found, "p4_quantiles": p4_quantiles, "p5_found": p5_found, "p6_found": p6_found}

_SET = "list_sort(list_distinct(coalesce({0}, []))) || [case when len(list_filter({0}, lambda x: x is null)) > 0 then 'null' else 'none' end]"


def _changes_sql(name: str, key: str, cols: list[str], arrays: list[str]) -> str:
    same = " and ".join([f"n.{c} is not distinct from o.{c}" for c in cols] + [f"n.{a} is not distinct from o.{a}" for a in arrays])
    picked = ", ".join([key, "release_version", *cols] + [f"{_SET.format(a)} as {a}" if a != "sponsors" else "list_sort(list_distinct(list_transform(coalesce(sponsors, []), lambda s: coalesce(s.sponsor_name, chr(1)) || chr(2) || coalesce(s.agency_class, chr(1)) || chr(2) || coalesce(s.lead_or_collaborator, chr(1))))) as sponsors" for a in arrays])
    return f"""
    select '{name}' as table_name, coalesce(n.{key}, o.{key}) as record_key, coalesce(n.release_version, o.later) as release_version,
      case when o.{key} is null then 'added' when n.{key} is null then 'removed' else 'changed' end as change_kind
    from (select l.* from {name}_s l join {name}_c c using (release_version) where c.earlier is not null) n
    full outer join (select l.*, c.later from {name}_s l join {name}_c c using (release_version) where c.later is not null) o
      on n.{key} = o.{key} and n.release_version = o.later
    where o.{key} is null or n.{key} is null or not ({same})""", f"""
    {name}_s as (select {picked} from (select *, row_number() over (partition by {key}, release_version order by loaded_at desc) as rn from {name} where {key} is not null) where rn = 1),
    {name}_c as (select release_version, lag(release_version) over (order by release_version) as earlier, lead(release_version) over (order by release_version) as later from (select distinct release_version from {name}))"""


_PATENTS = _changes_sql("patents", "patent_number", ["id", "country", "publication_date", "title", "family_id", "description"], ["assignees", "ipc", "cpc", "ipcr"])
_TRIALS = _changes_sql("trials", "nct_id", ["brief_title", "official_title", "brief_summary", "overall_status", "phase", "study_type", "enrollment", "start_date", "completion_date", "eligibility"], ["conditions", "sponsors"])

SQL = {
    "p4_found": """
    with named as (
      select cid, 'pat_nums' as field_name, upper(trim(k)) as key_value from (select cid, unnest(pat_nums) as k from validate_patent_text_support)
      union all select cid, 'pred_accs', upper(trim(k)) from (select cid, unnest(pred_accs) as k from validate_patent_text_support))
    select field_name, key_value from named where key_value <> '' group by all
    having count(distinct cid) >= 0.05 * (select count(distinct cid) from validate_patent_text_support)""",
    "p4_quantiles": """
    with pairs as (select upper(trim(a)) as acc, c as conf from (select unnest(pred_accs) as a, unnest(pred_confs) as c from validate_patent_text_support)),
    ranked as (select acc, conf, row_number() over (partition by acc order by conf) as rk, count(*) over (partition by acc) as n
      from pairs where acc <> '' and conf is not null and not isnan(conf))
    select acc, n as n_rows, max(case when rk = greatest(1, ceil(0.5::double * n)) then conf end) as median_conf,
      max(case when rk = greatest(1, ceil(0.9::double * n)) then conf end) as p90_conf from ranked group by acc, n""",
    "p5_found": """
    with latest as (select acc, pid, support, confidence, row_number() over (partition by acc, pid order by scored_at desc) as rn
      from compound_predictions where acc is not null and pid is not null),
    ranked as (select acc, pid, row_number() over (partition by acc order by support desc, confidence desc, pid) as rk
      from latest where rn = 1 and support is not null and confidence is not null and not isnan(confidence))
    select acc, pid from ranked where rk <= 5""",
    "p6_found": f"with {_PATENTS[1]}, {_TRIALS[1]} {_PATENTS[0]} union all {_TRIALS[0]}",
}
