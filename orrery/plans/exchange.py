"""Queries that write a file kind and read it again: readers, writers and the versions of collections. Files go to the
shared folder of the session, under a name of their own."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators import state
from orrery.plans.library import PAT, TRI, _long, _newest
from orrery.session import shared_folder, table
from orrery.sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/exchange-{uuid.uuid4().hex}"


@query("select cid, smiles from chembl where smiles <> ''")
def read_key_value_tsv(spark, d):
    """Gzipped TSV without header; a row whose key is no number is skipped."""
    path = scratch(spark)
    t = table(spark, d, "chembl").filter("smiles <> ''").select(F.col("cid").cast("string").alias("k"), "smiles")
    writers.tsv(t.unionByName(spark.createDataFrame([("cid", "smiles"), ("x7", "C")], "k string, smiles string")), path, header=False, gzipped=True)
    return readers.key_value_tsv(spark, path)


@query("select acc, gene, target_name from targets where gene is not null and target_name is not null")
def read_headed_tsv(spark, d):
    path = scratch(spark)
    writers.tsv(table(spark, d, "targets").filter("gene is not null and target_name is not null").select("acc", "gene", "target_name"), path)
    return spark.read.csv(path, sep="\t", header=True, schema="acc string, gene string, target_name string")


@query("select distinct pid as cid, acc as label from compound_predictions where pid is not null and acc is not null")
def read_label_map(spark, d):
    path = scratch(spark)
    writers.label_maps(table(spark, d, "compound_predictions").filter("pid is not null and acc is not null"), path, "pid", "acc")
    return readers.label_map_json(spark, path)


@query(f"select nct_id, brief_title, md5(brief_summary) as summary_md5, enrollment, len(conditions) as n_conditions from {TRI}")
def read_wrapped_json(spark, d):
    path = scratch(spark)
    t = _newest(spark, d, "trials", "nct_id").select("nct_id", "brief_title", "brief_summary", "enrollment", "conditions")
    writers.wrapped_json(t, path, "trials", "nct_id", 500)
    out = readers.wrapped_json(spark, path, "trials", "nct_id string, brief_title string, brief_summary string, enrollment int, conditions array<string>")
    n = F.when(F.col("conditions").isNotNull(), F.size("conditions")).cast("bigint")
    return out.select("nct_id", "brief_title", F.md5("brief_summary").alias("summary_md5"), "enrollment", n.alias("n_conditions"))


@query(f"select nct_id, md5(brief_summary) as summary_md5, enrollment from {TRI}")
def read_json_array_stream(spark, d):
    """The same kind of file, row by row."""
    path = scratch(spark)
    writers.wrapped_json(_newest(spark, d, "trials", "nct_id").select("nct_id", "brief_summary", "enrollment"), path, "trials", "nct_id", 100_000)
    out = readers.json_array_stream(spark, path, "trials", "nct_id string, brief_summary string, enrollment int")
    return out.select("nct_id", F.md5("brief_summary").alias("summary_md5"), "enrollment")


@query("select doc_id, source, md5(text) as text_md5 from documents where length(text) > 0")
def read_json_shards(spark, d):
    """Shards of JSON lines; rows with empty text are skipped in reading."""
    path = scratch(spark)
    writers.json_shards(table(spark, d, "documents").select("doc_id", "source", "text"), path, 300)
    return readers.json_lines(spark, path, "doc_id bigint, source string, text string").select("doc_id", "source", F.md5("text").alias("text_md5"))


@query(f"select nct_id, md5(brief_summary) as summary_md5 from {TRI} where brief_summary <> ''")
def read_pipe_table(spark, d):
    """Texts with line ends, quotes and pipes come back as they were."""
    path = scratch(spark)
    writers.pipe_table(_newest(spark, d, "trials", "nct_id").filter("brief_summary <> ''").select("nct_id", "brief_summary"), path)
    return readers.pipe_table(spark, path, "nct_id string, brief_summary string").select("nct_id", F.md5("brief_summary").alias("summary_md5"))


_WORDS = "trim(regexp_replace(text, '[^A-Za-z0-9]+', ' '{0}))"


@query(f"select doc_id::varchar as pmid, 'Title: Note ' || doc_id || chr(10) || 'Abstract: ' || {_WORDS.format(', ' + chr(39) + 'g' + chr(39))} as body from documents where {_WORDS.format(', ' + chr(39) + 'g' + chr(39))} <> ''")
def read_articles_xml(spark, d):
    """Gzipped XML records, of which those without abstract are left out."""
    from orrery.functions.records import titled_abstract

    path = scratch(spark)
    words = F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    body = F.when(words != "", F.concat(F.lit("<Abstract><AbstractText>"), words, F.lit("</AbstractText></Abstract>"))).otherwise("")
    record = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("doc_id").cast("string"), F.lit("</PMID><Article><ArticleTitle>Note "), F.col("doc_id").cast("string"), F.lit("</ArticleTitle>"), F.coalesce(body, F.lit("")), F.lit("</Article></MedlineCitation></PubmedArticle>"))
    t = table(spark, d, "documents").select("doc_id", record.alias("record"))
    shards = max(1, t.count() // 300)  # files of one root each, of a bounded number of records
    packed = t.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("s")).agg(F.array_join(F.collect_list("record"), "").alias("all"))
    packed.select(F.concat(F.lit("<PubmedArticleSet>"), "all", F.lit("</PubmedArticleSet>")).alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return readers.articles_xml(spark, path).select("pmid", titled_abstract(F.col("title"), F.col("abstract")).alias("body"))


@query("""select acc as accession, acc || '_X' as entry, case when org like 'Homo%' then 9606 end as taxid, md5(acc) || md5(gene) as sequence from targets where gene is not null
union all select acc, null, null, md5(acc) from targets where gene is null""")
def read_fasta(spark, d):
    """Two FASTA data sets read as one, with headers of three fields and of one."""
    path, t = scratch(spark), table(spark, d, "targets")
    tax = F.when(F.col("org").startswith("Homo"), " OX=9606 GN=x").otherwise("")
    full = F.concat(F.lit(">sp|"), "acc", F.lit("|"), "acc", F.lit("_X some protein"), tax, F.lit("\n"), F.md5("acc"), F.lit("\n"), F.md5("gene"))
    t.filter("gene is not null").select(F.coalesce(full, F.concat(F.lit(">sp|"), "acc", F.lit("|"), "acc", F.lit("_X\n"), F.md5("acc"), F.lit("\n"), F.md5("gene")))).write.text(f"{path}/a")
    t.filter("gene is null").select(F.concat(F.lit(">"), "acc", F.lit("\n"), F.md5("acc"))).write.text(f"{path}/b")
    return readers.fasta(spark, f"{path}/a").unionByName(readers.fasta(spark, f"{path}/b"))


@query("""with h as (select o_custkey::varchar as query_id, (o_orderkey % 150)::varchar as target_id, (o_orderkey % 71 + 20)::double as identity, (o_orderkey * 7 % 1000)::double as bitscore, o_orderkey from orders)
select query_id, target_id, identity, bitscore, row_number() over (partition by query_id order by bitscore desc, target_id, identity) as place from h where query_id <> target_id and identity >= 30 qualify place <= 5""")
def read_alignment_top(spark, d):
    """The five best hits of every query in a twelve-column table, without itself and weak ones."""
    from orrery.operators.transfer import rank_within

    path, k = scratch(spark), F.col("o_orderkey")
    zero = [F.lit(0) for _ in range(7)]
    t = table(spark, d, "orders").select(F.col("o_custkey").cast("string"), (k % 150).cast("string"), (k % 71 + 20).cast("double"), *zero, F.lit(0.5), (k * 7 % 1000).cast("double"))
    writers.tsv(t.toDF(*[f"c{i}" for i in range(12)]), path, header=False)
    hits = rank_within(readers.alignment_hits(spark, path, 30), "query_id", F.col("bitscore").desc(), F.col("target_id"), F.col("identity"), name="place")
    return hits.filter("place <= 5").select("query_id", "target_id", "identity", "bitscore", *_long("place"))


@query(f"select nct_id, phase from {TRI} where enrollment >= 100")
def read_id_set(spark, d):
    """Rows on an allow-list of ids that has comments, blanks and repeats."""
    path, t = scratch(spark), _newest(spark, d, "trials", "nct_id")
    ids = t.filter("enrollment >= 100").select(F.explode(F.array("nct_id", F.lit("# a comment"), F.lit(""), F.concat(F.lit(" "), "nct_id"))).alias("value"))
    ids.write.option("compression", "gzip").text(path)
    allowed = readers.id_set(spark, path).withColumnRenamed("id", "nct_id")
    return t.join(allowed, "nct_id", "left_semi").select("nct_id", "phase")


@query("""select count(*) as n_read, count(*) filter (where smiles is null or trim(smiles) = '' or mol_weight is null) as n_bad,
round(avg(mol_weight) filter (where smiles is not null and trim(smiles) <> ''), 6) as mean_label from patent_compounds""")
def read_labelled_csv(spark, d):
    path = scratch(spark)
    table(spark, d, "patent_compounds").select("smiles", F.coalesce(F.col("mol_weight").cast("string"), F.lit("n/a")).alias("y")).write.csv(path, header=True, escape='"')
    good, counts = readers.labelled_csv(spark, path, "smiles", "y")
    return counts.join(good.agg(F.round(F.avg("label"), 6).alias("mean_label")))  # one row each


@query("select vec_id, label, round(list_sum(embedding::double[]), 4) as total from embeddings where label % 2 = 0")
def read_vectors_with_sidecar(spark, d):
    """Vectors in one file kind, what they are in another, joined by position."""
    path, e = scratch(spark), table(spark, d, "embeddings")
    e.select(F.col("vec_id").alias("position"), F.col("embedding").alias("vector")).write.parquet(f"{path}/vectors")
    e.filter("label % 2 = 0").select(F.col("vec_id").alias("position"), "vec_id", "label").write.json(f"{path}/side")
    out = readers.vectors_with_sidecar(spark.read.parquet(f"{path}/vectors"), spark.read.schema("position bigint, vec_id bigint, label bigint").json(f"{path}/side"))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return out.select("vec_id", F.col("label").cast("int").alias("label"), F.round(total, 4).alias("total"))


@query("select id, popcount from patent_compounds where id > 1000 and id <= 2000")
def read_sorted_range(spark, d):
    """A range of keys out of a table sorted by key, where all other row groups are skipped by their statistics."""
    path = scratch(spark)
    writers.sorted_parquet(table(spark, d, "patent_compounds").select("id", "popcount"), path, "id", 8, row_group_rows=500_000)
    return spark.read.parquet(path).filter("id > 1000 and id <= 2000")


@query("select count(*) as n_rows, count(distinct id) as n_keys, 4 as first_pass, 1 as second_pass from patent_compounds")
def write_chunks_once(spark, d):
    """Chunks by key; a second pass writes only the chunk that was lost."""
    path, t = scratch(spark), table(spark, d, "patent_compounds").select("id", "mol_weight")
    first = len(writers.keyed_chunks(t, path, "id", 4))
    fs, folder = writers._fs(spark, path)
    fs.delete(folder(f"{path}/chunk=2"), True)
    second = len(writers.keyed_chunks(t, path, "id", 4))
    out = spark.read.parquet(path)
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_keys")).select("n_rows", "n_keys", F.lit(first).alias("first_pass"), F.lit(second).alias("second_pass"))


@query("select (select count(*) from patent_compounds) as n_in, (select count(*) from patent_compounds) as n_out, 0::bigint as n_lost, 0.0::double as delta_pct, true as refused")
def copy_and_switch(spark, d):
    """A clean copy, a switch that is refused for a version that lacks rows, one that is not, and the reconciliation."""
    path, t = scratch(spark), table(spark, d, "patent_compounds").select("id", "smiles")
    t.write.parquet(f"{path}/v0")
    t.filter("id % 2 = 0").write.parquet(f"{path}/half")
    writers.copied(spark, f"{path}/v0", f"{path}/v1", "id")
    n = t.count()
    try:
        writers.switch_view(spark, "orrery_current", f"{path}/half", n)
        refused = n == 0
    except ValueError:
        refused = True
    writers.switch_view(spark, "orrery_current", f"{path}/v1", n)
    return writers.reconcile(t, spark.table("orrery_current"), "id").withColumn("refused", F.lit(refused))


@query(f"""select patent_number, title, country, publication_date, length(nullif(description, '')) as n_chars from (select patent_number, regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g') as title, country, publication_date,
trim(regexp_replace(description, '[^A-Za-z0-9]+', ' ', 'g')) as description from {PAT} where title is not null and patent_number is not null) where trim(title) <> '' and trim(title) = title""")
def read_patent_zips(spark, d):
    """Archives of concatenated XML documents, one archive a partition, read back as records."""
    plain = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]+", " ")
    t = _newest(spark, d, "patents", "patent_number").filter("title is not null and patent_number is not null").withColumn("title", plain("title")).filter("trim(title) <> '' and trim(title) = title")
    parts, day = F.split("patent_number", "-"), F.coalesce(F.date_format("publication_date", "yyyyMMdd"), F.lit(""))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), F.coalesce(c, F.lit("")), F.lit(f"</{name}>"))
    ident = F.concat(tag("country", parts[0]), tag("doc-number", parts[1]), tag("kind", F.coalesce(F.get(parts, F.lit(2)), F.lit(""))), tag("date", day))
    text = F.trim(plain("description"))
    xml = F.concat(F.lit('<?xml version="1.0"?>\n<us-patent-grant><publication-reference><document-id>'), ident, F.lit("</document-id></publication-reference>"), tag("invention-title", F.col("title")), tag("description", tag("p", text)), F.lit("</us-patent-grant>\n"))

    def packed(batches):
        for batch in batches:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("docs.xml", "".join(batch.column("xml").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(["a.zip"]), pa.array([out.getvalue()])], ["path", "content"])

    files = t.select(xml.alias("xml")).mapInArrow(packed, "path string, content binary")
    return readers.patent_zips(files).select("patent_number", "title", "country", "publication_date", F.length("description").cast("bigint").alias("n_chars"))


@query(f"select patent_number, title, country, publication_date from {PAT} where title is not null and country = 'US' and len(string_split(patent_number, '-')) = 3 and patent_number not like '%--%'")
def read_nested_patents(spark, d):
    """Nested JSON in folders by country, only ids that are asked for."""
    path, parts = scratch(spark), F.split("patent_number", "-")
    t = _newest(spark, d, "patents", "patent_number").filter("title is not null").filter(F.size(parts) == 3)
    ident = F.struct(parts[0].alias("country"), parts[1].alias("number"), parts[2].alias("kind"))
    doc = F.struct(ident.alias("id"), F.struct("title").alias("text"), F.date_format("publication_date", "yyyyMMdd").alias("published"))
    t.select(doc.alias("patent"), F.coalesce("country", F.lit("none")).alias("folder")).write.partitionBy("folder").json(path)
    ids = t.filter("country = 'US'").select(F.col("patent_number").alias("id"))
    return readers.nested_patents(spark, path, ids).select("patent_number", "title", "country", "publication_date")


@query("select doc_id, lang from documents union all select item_id, task from eval_items")
def read_parts_as_one(spark, d):
    path = scratch(spark)
    table(spark, d, "documents").select("doc_id", "lang").write.parquet(f"{path}/part=1")
    table(spark, d, "eval_items").select(F.col("item_id").alias("doc_id"), F.col("task").alias("lang")).write.parquet(f"{path}/part=2")
    return spark.read.parquet(path).select("doc_id", "lang")


# ---- state of incremental runs ------------------------------------------------------------------------------------------


_HASHED = "select nct_id, release_version, md5(coalesce(brief_title, '') || '|' || coalesce(overall_status, '')) as h from (select *, row_number() over (partition by nct_id, release_version order by loaded_at desc) as rn from trials) where rn = 1"
_ORDERED = "rv as (select list(distinct release_version order by release_version) as v from trials)"


def _hashed(spark, d):
    t = state.pick_latest(table(spark, d, "trials").select("nct_id", "release_version", "loaded_at", "brief_title", "overall_status"), ["nct_id", "release_version"], "loaded_at")
    names = [r[0] for r in table(spark, d, "trials").select("release_version").distinct().orderBy("release_version").collect()]  # a calendar
    return t.select("nct_id", "release_version", F.md5(F.concat_ws("|", F.coalesce("brief_title", F.lit("")), F.coalesce("overall_status", F.lit("")))).alias("h")), names


@query(f"with t as ({_HASHED}), {_ORDERED}, o as (select t.* from t, rv where release_version = v[-2]), n as (select t.* from t, rv where release_version = v[-1]) select n.nct_id, case when o.h is null then 'new' when o.h <> n.h then 'changed' else 'unchanged' end as status, true as committed from n left join o using (nct_id)")
def commit_after_insert(spark, d):
    """A run whose insert fails leaves the state as it was; the next one does the same work and commits it."""
    path, (t, names) = scratch(spark), _hashed(spark, d)
    old, new = (t.filter(F.col("release_version") == r).select("nct_id", "h") for r in names[-2:])
    state.commit_after_insert(spark, old, "nct_id", "h", f"{path}/state", lambda rows: rows.write.parquet(f"{path}/store"))

    def fails(rows):
        raise OSError("store is away")

    try:
        state.commit_after_insert(spark, new, "nct_id", "h", f"{path}/state", fails)
    except OSError:
        pass
    unmoved = state._last_version(spark, f"{path}/state") == 0
    status = state.commit_after_insert(spark, new, "nct_id", "h", f"{path}/state", lambda rows: state.with_retry(lambda: rows.write.mode("append").parquet(f"{path}/store")))
    again = state.compare_state(new, spark.read.parquet(f"{path}/state/v1"), "nct_id", "h").filter("status <> 'unchanged'").isEmpty()
    return status.withColumn("committed", F.lit(unmoved and again))


@query("""with c as (select * from (select *, dense_rank() over (partition by nct_id order by release_version desc) as r from (select distinct nct_id, release_version, unnest(conditions) as term from trials)) where r = 1)
select nct_id, term from c""")
def replace_document(spark, d):
    """Terms of a record as of the last release that names any: each release replaces all rows of its records."""
    t = table(spark, d, "trials").select("nct_id", "release_version", F.explode("conditions").alias("term")).distinct()
    names = [r[0] for r in t.select("release_version").distinct().orderBy("release_version").collect()]  # a calendar
    rows = [t.filter(F.col("release_version") == r).select("nct_id", "term") for r in names]
    out = rows[0]
    for patch in rows[1:]:
        out = state.replace_documents(out, patch, "nct_id")
    return out


@query(f"with t as ({_HASHED}), {_ORDERED} select nct_id, h from t, rv where release_version = v[-1] and nct_id not in (select nct_id from trials where upper(trim(overall_status)) = 'WITHDRAWN' and nct_id is not null)")
def tombstone_anti(spark, d):
    """Records without those that were withdrawn in any release."""
    t, names = _hashed(spark, d)
    gone = table(spark, d, "trials").filter(F.upper(F.trim("overall_status")) == "WITHDRAWN").select("nct_id")
    return state.without_deleted(t.filter(F.col("release_version") == names[-1]).select("nct_id", "h"), gone, "nct_id")


@query(f"with t as ({_HASHED}) select nct_id, arg_max(h, release_version) as h, max(release_version) as release_version from t group by nct_id")
def newest_version_wins(spark, d):
    """Releases applied in the wrong order: an older one never replaces a newer one."""
    t, names = _hashed(spark, d)
    out = t.filter(F.col("release_version") == names[-1])
    for r in names[:-1]:
        out = state.upsert_newer(out, t.filter(F.col("release_version") == r), ["nct_id"], "release_version")
    return out.select("nct_id", "h", "release_version")


@query(f"with t as ({_HASHED}), {_ORDERED}, a as (select t.* from t, rv where release_version = v[1]) select nct_id, h from a union all select t.nct_id, t.h from t, rv where release_version = v[-1] and t.nct_id not in (select nct_id from a)")
def add_only_merge(spark, d):
    """New records are added, nothing is overwritten."""
    t, names = _hashed(spark, d)
    first, last = (t.filter(F.col("release_version") == r).select("nct_id", "h") for r in (names[0], names[-1]))
    return state.add_only(first, last, ["nct_id"])


@query("""with w as (select distinct upper(trim(k)) as key from (select unnest(pat_nums) as k from validate_patent_text_support) where trim(k) <> ''), p as (select patent_number as key, max(title) as payload from patents group by 1)
select key, case when length(key) % 5 = 0 and p.key is null then 'error' when p.key is null then 'miss' when payload is null then 'miss' else 'hit' end as status, payload from w left join p using (key)""")
def read_through_cache(spark, d):
    """Titles of patents by number: hits and misses are remembered, failures that may pass are not."""
    key = F.upper(F.trim("k"))
    wanted = table(spark, d, "validate_patent_text_support").select(F.explode("pat_nums").alias("k")).select(key.alias("key")).filter("key <> ''")
    titles = table(spark, d, "patents").groupBy(F.col("patent_number").alias("key")).agg(F.max("title").alias("payload"))
    found = wanted.distinct().join(titles.withColumn("there", F.lit(True)), "key", "left")
    status = F.when(F.col("payload").isNotNull(), "hit").when(F.col("there").isNull() & (F.length("key") % 5 == 0), "error").otherwise("miss")
    fetched = found.select("key", status.alias("status"), "payload")
    empty = spark.createDataFrame([], "key string, status string, payload string")
    _, cache = state.read_through(empty, wanted.filter(F.length("key") % 2 == 0), fetched)
    return state.read_through(cache, wanted, fetched)[0]


@query("select strftime(o_orderdate, '%Y-%m') as file, max(o_orderkey % 97) as n_rows, max(o_orderkey % 97) as finished_at from orders group by 1")
def ledger_merge(spark, d):
    """One entry a file out of many runs' ledgers, the latest."""
    t = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("file"), (F.col("o_orderkey") % 97).alias("n_rows"), (F.col("o_orderkey") % 97).alias("finished_at"))
    return state.merge_ledger(t.filter("n_rows % 2 = 0"), t.filter("n_rows % 2 = 1"))


@query("""with l as (select distinct loaded_at::date as day from patents), g as (select day, lag(day) over (order by day) as last_run from l)
select day, case when last_run is null then 'fresh' when date_diff('day', last_run, day) < 7 then 'skip' else 'update' end as mode from g""")
def run_modes(spark, d):
    """What a run on each loading day has to do, when it is to work once a week."""
    days = table(spark, d, "patents").select(F.col("loaded_at").cast("date").alias("day")).filter("day is not null").distinct()
    last = F.lag("day").over(Window.orderBy("day"))  # a calendar
    return days.withColumn("last_run", last).select("day", state.run_mode_of(F.col("last_run"), F.col("day"), F.lit(True), 7).alias("mode"))
