"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.leaks import leaked_items
from orrery.llm.lookalike import COMPATIBLE, FOREIGN_LIKE, consistent_texts, lookalike_pairs
from orrery.llm.mixing import mix_sized, mix_sources
from orrery.llm.names import name_entities, same_entity_pairs
from orrery.llm.split import split_texts
from orrery.llm.vectors import nearest_fingerprints
from orrery.operators.topn import latest_rows
from orrery.session import table


def _typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    patents = table(spark, sf_dir, "patents").select(F.explode("assignees").alias("name"))
    sponsors = table(spark, sf_dir, "tier1_coverage_stats").select(F.explode(F.map_keys("top_sponsors")).alias("name"))
    return patents.unionByName(sponsors)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_entity_pairs(name_entities(_typed_names(spark, sf_dir)))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the smallest spelling of its entity."""
    named = name_entities(_typed_names(spark, sf_dir))
    return named.join(named.groupBy("entity").agg(F.min("name").alias("entity_name"), F.count(F.lit(1)).alias("n_spellings")), "entity").select("name", "entity_name", "n_spellings")


_SPLITS = (("trials", "nct_id", "brief_summary", 500, 50), ("patents", "patent_number", "description", 1000, 100))


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    out = None
    for name, key, text, limit, overlap in _SPLITS:
        t = table(spark, sf_dir, name)
        newest = t.agg(F.max("release_version")).first()[0]
        rows = t.filter(F.col("release_version") == F.lit(newest)).filter(F.col(key).isNotNull())
        now = latest_rows(rows, [key], "loaded_at", [text])
        pieces = split_texts(now.select(F.lit(name).alias("table_name"), F.col(key).alias("record_key"), text), ["table_name", "record_key"], text, limit, overlap, with_text)
        out = pieces if out is None else out.unionByName(pieces)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record is cut hard exactly if it holds a stretch without white space longer than the limit."""
    forced = F.max(F.when(F.col("how") == "hard", 1).otherwise(0))
    cuts = _pieces(spark, sf_dir, False).groupBy("table_name", "record_key").agg(forced.alias("forced"))
    return cuts.select("table_name", "record_key", F.when(F.col("forced") == 1, "forced").otherwise("boundary").alias("cut_kind"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    compounds = table(spark, sf_dir, "patent_compounds").select("id", "fp")
    return nearest_fingerprints(compounds, table(spark, sf_dir, "chembl").select("cid", "fp")).select("id", "cid")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaked_items(docs, table(spark, sf_dir, "eval_items").select("item_id", "passage"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"))[1]


def p8_budget(spark: SparkSession, sf_dir: str, budget: int = 500_000) -> DataFrame:
    """The mixture cut at a total budget of tokens."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"), budget)[0]


def _sized(spark: SparkSession, sf_dir: str, budget: int | None) -> tuple[DataFrame, DataFrame]:
    sized = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", F.col("n_chars").alias("n_tokens"))
    return mix_sized(sized, table(spark, sf_dir, "source_mix"), budget)


def p8_characters(spark: SparkSession, sf_dir: str, budget: int = 200_000) -> DataFrame:
    """The same queue over sizes that a table holds: characters instead of tokens, cut at a budget."""
    return _sized(spark, sf_dir, budget)[0].select("doc_id", F.col("copy_no").cast("bigint").alias("copy_no"), "source", F.round("finish", 3).alias("finish"))


def p8_character_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _sized(spark, sf_dir, None)[1]
    return out.select("source", "tokens", "docs", F.col("most_copies").cast("bigint").alias("most_copies"), F.round("actual_share", 9).alias("actual_share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "documents"))


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_texts(table(spark, sf_dir, "documents")).select("doc_id", F.col("form").alias("text"))


QUERIES = {
    "p1_found": p1_found, "p1_entities": p1_entities, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p7_found": p7_found,
    "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_budget": p8_budget, "p8_characters": p8_characters, "p8_character_shares": p8_character_shares,
    "p9_found": p9_found, "p9_texts": p9_texts,
}


def _long_sql(name: str, key: str, text: str, limit: int) -> str:
    stretch = f"regexp_matches(t, '[^\\s\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]{{{limit}}}[^\\s\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')"
    return f"""
    select '{name}' as table_name, k as record_key, case when {stretch} then 'forced' else 'boundary' end as cut_kind
    from (select {key} as k, {text} as t, row_number() over (partition by {key} order by loaded_at desc, {text} desc nulls last) as rn
      from {name} where release_version = (select max(release_version) from {name}) and {key} is not null)
    where rn = 1 and length(t) > {limit}"""


def _form_sql(text: str) -> str:
    """The skeleton of a text: plain forms and blanks, no format characters, look-alikes as their Latin twins."""
    wide = {i: c for i, c in COMPATIBLE.items() if c is not None and i != 0x20 and len(c) == 1}
    plain = f"translate(nfc_normalize({text}), '{''.join(map(chr, wide))}', '{''.join(wide.values()).replace(chr(39), chr(39) * 2)}')"
    seen = f"regexp_replace({plain}, '[\\p{{Cf}}\\x{{fe00}}-\\x{{fe0f}}\\x{{34f}}]', '', 'g')"
    twins = {chr(i): c for i, c in FOREIGN_LIKE.items()}
    for i in range(0x370, 0x590):  # composed letters whose base is a look-alike
        base, *marks = unicodedata.normalize("NFD", chr(i))
        if marks and base in twins and len(both := unicodedata.normalize("NFC", twins[base] + "".join(marks))) == 1:
            twins[chr(i)] = both
    return f"nfc_normalize(translate(nfc_normalize({seen}), '{''.join(twins)}', '{''.join(twins.values())}'))"


def _runs_sql(table_name: str, key: str, text: str) -> str:
    words = f"regexp_extract_all(lower({_form_sql(text)}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""(select distinct {key}, array_to_string(w[i : i + 11], ' ') as run from (select {key}, w, unnest(range(1, len(w) - 10)) as i
      from (select {key}, {words} as w from {table_name} where {text} is not null) where len(w) >= 12))"""


_QUEUE = """
    with l as (select lower(trim(source)) as source, target_share, max_repeats from source_mix where target_share > 0 and max_repeats > 0),
    d as (select doc_id, lower(trim(source)) as source, n_chars as n, ('0x' || substr(md5('7:' || doc_id::varchar), 1, 15))::bigint as h from documents where text is not null and n_chars > 0),
    o as (select doc_id, source, n, target_share, max_repeats, sum(n) over (partition by source order by h, doc_id) as upto, sum(n) over (partition by source) as once from d join l using (source)),
    c as (select *, (upto + (copy_no - 1) * once)::double / target_share as finish from (select *, unnest(range(1, max_repeats + 1)) as copy_no from o))"""

SQL: dict[str, str] = {
    "p8_characters": f"""{_QUEUE}
    select doc_id, copy_no, source, round(finish, 3) as finish from (select *, sum(n) over (order by finish, source, doc_id, copy_no) as filled from c) where filled <= 200000""",
    "p8_character_shares": f"""{_QUEUE},
    m as (select * from c where finish <= (select min(once * max_repeats / target_share) from o) * (1 + 1e-12::double)),
    u as (select source, sum(n)::bigint as tokens, count(distinct doc_id) as docs, max(copy_no) as most_copies from m group by source)
    select s.source, coalesce(tokens, 0) as tokens, coalesce(docs, 0) as docs, coalesce(most_copies, 0) as most_copies, round(coalesce(tokens::double / (select sum(tokens) from u), 0), 9) as actual_share
    from (select lower(trim(source)) as source from source_mix) s left join u using (source)""",
    "p7_found": f"select distinct doc_id, item_id from {_runs_sql('documents', 'doc_id', 'text')} join {_runs_sql('eval_items', 'item_id', 'passage')} using (run)",
    "p9_found": f"""
    with f as (select doc_id, text, {_form_sql('text')} as form from documents where text is not null)
    select distinct a.doc_id as doc_a, b.doc_id as doc_b from f a join f b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text where trim(a.form) <> ''""",
    "p2_found": _long_sql("trials", "nct_id", "brief_summary", 500) + " union all " + _long_sql("patents", "patent_number", "description", 1000),
    "p3_found": """
    with q as (select distinct id, fp from patent_compounds where fp is not null and len(fp) = 32),
    r as (select distinct cid, fp from chembl where fp is not null and len(fp) = 32),
    pairs as (select id, cid, list_sum(list_transform(range(1, 33), lambda i: bit_count(q.fp[i] & r.fp[i]))) as shared,
      list_sum(list_transform(range(1, 33), lambda i: bit_count(q.fp[i] | r.fp[i]))) as total from q cross join r)
    select id, cid from (select id, cid, row_number() over (partition by id order by shared::double / total desc, cid) as rk
      from pairs where total > 0 and shared::double / total >= 0.5) where rk <= 10""",
}
