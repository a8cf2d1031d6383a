import gzip

import pytest

from orrery.operators import state
from orrery.operators.order import running_number, running_sum
from orrery.sources import readers, writers
from orrery.streaming.incremental import current_rows, upsert_batches


def put(path, text):
    path.write_text(text)
    return str(path)


def test_readers(spark, tmp_path):
    assert readers.key_value_tsv(spark, put(tmp_path / "a.tsv", "1\tCC\nx\tCO\n22\tN\n")).collect() == [(1, "CC"), (22, "N")]
    assert sorted(readers.label_map_json(spark, put(tmp_path / "m.json", '{"1": ["P1", "P2"], "2": []}')).collect()) == [(1, "P1"), (1, "P2")]
    for i, text in enumerate(('{"trials": [{"nct_id": "N1"}, {"nct_id": "N2"}]}', '[{"nct_id": "N1"}, {"nct_id": "N2"}]')):
        assert [r.nct_id for r in readers.wrapped_json(spark, put(tmp_path / f"t{i}.json", text), "trials", "nct_id string").collect()] == ["N1", "N2"]
    assert readers.json_lines(spark, put(tmp_path / "l.json", '{"text": "a"}\n\n{"text": ""}\n'), "text string").count() == 1
    assert readers.pipe_table(spark, put(tmp_path / "p.txt", 'a|b\n1|"x\ny"\n'), "a int, b string").collect() == [(1, "x\ny")]
    fasta = put(tmp_path / "f.fa", ">sp|P1|AB_HUMAN Protein OS=Homo sapiens OX=9606 GN=AB\nMK\nLV\n>Q2\nAA\n")
    assert [tuple(r) for r in readers.fasta(spark, fasta).collect()] == [("P1", "AB_HUMAN", 9606, "MKLV"), ("Q2", None, None, "AA")]
    hits = put(tmp_path / "h.tsv", "a\ta\t100\t9\t0\t0\t1\t9\t1\t9\t0\t50\na\tb\t40\t9\t0\t0\t1\t9\t1\t9\t0\t30\na\tc\t20\t9\t0\t0\t1\t9\t1\t9\t0\t20\n")
    assert [r.target_id for r in readers.alignment_hits(spark, hits, 30).collect()] == ["b"]
    with gzip.open(tmp_path / "ids.gz", "wt") as f:
        f.write("# c\nA\nA\n\nB\n")
    assert {r.id for r in readers.id_set(spark, str(tmp_path / "ids.gz")).collect()} == {"A", "B"}
    good, counts = readers.labelled_csv(spark, put(tmp_path / "q.csv", "s,y\nCC,1\n,0\nCO,x\n"), "s", "y")
    assert good.collect() == [("CC", 1.0)] and counts.collect() == [(3, 2)]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_array_items_in_pieces(size):
    import io
    import json

    def items(text):
        return [json.loads(x) for x in readers._array_items(io.BytesIO(text.encode()).read, "rows", size)]

    rows = [{"a": "é ] } " + chr(92) + '" ,', "b": [1, {"c": None}]}, 12, 1.5e3, "x", [], True]
    assert items(json.dumps(rows, ensure_ascii=False)) == rows
    assert items(' { "n": 7, "other": [{"rows": [1]}], "rows" : ' + json.dumps(rows, indent=1) + ', "z": 1}') == rows
    assert items("[]") == items('{"rows": []}') == items("  ") == items("7") == []
    with pytest.raises(ValueError):
        items('[{"a": 1}, {"b"')


def test_articles(spark, tmp_path):
    xml = "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version='1'>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label='A'>one</AbstractText><AbstractText Label='B'>two</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID Version='1'>8</PMID><Article><ArticleTitle>U</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"
    assert [tuple(r) for r in readers.articles_xml(spark, put(tmp_path / "a.xml", xml)).collect()] == [("7", "T", "one two")]


def test_writers(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 as g")
    p = str(tmp_path / "v0")
    writers.sorted_parquet(df, p, "id", 4)
    writers.upsert_version(spark, p, spark.createDataFrame([(5, 9), (200, 9)], "id bigint, g bigint"), ["id"], str(tmp_path / "v1"))
    new = spark.read.parquet(str(tmp_path / "v1"))
    assert new.count() == 101 and new.filter("g = 9").count() == 2
    assert tuple(writers.reconcile(df, new, "id").first()) == (100, 101, 0, 1.0)
    writers.switch_view(spark, "current", str(tmp_path / "v1"), 101)
    assert spark.table("current").count() == 101
    with pytest.raises(ValueError):
        writers.switch_view(spark, "current", p, 101)
    writers.chunked_parquet(df.coalesce(1), str(tmp_path / "c"), 30)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 4


def test_many_wrapped_objects(spark, tmp_path):
    """Every shard is a file of its own, as a file holds one object."""
    df = spark.range(60).selectExpr("id", "concat('v', id % 7) as x")
    writers.wrapped_json(df, str(tmp_path / "w"), "rows", "id", 4)
    assert sorted(tuple(r) for r in readers.wrapped_json(spark, str(tmp_path / "w"), "rows", "id bigint, x string").collect()) == [(i, f"v{i % 7}") for i in range(60)]
    assert readers.json_array_stream(spark, str(tmp_path / "w"), "rows", "id bigint").count() == 60
    writers.label_maps(df, str(tmp_path / "m"), "id", "x", 4)
    assert readers.label_map_json(spark, str(tmp_path / "m")).count() == 60


def test_stream_upserts(spark, tmp_path):
    schema = "k int, v int, x string"
    for i, rows in enumerate([[(1, 1, "a"), (1, 5, "b"), (2, 1, "c"), (3, 1, "d")], [(1, 2, "late"), (2, 7, "new")], [(2, 7, "new")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        upsert_batches(stream, "k", "v", str(tmp_path / "out"), str(tmp_path / "ck"), buckets=4).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "in")).count() == (4, 6, 7)[i]
    assert {tuple(r) for r in current_rows(spark, str(tmp_path / "out")).select("k", "v", "x").collect()} == {(1, 5, "b"), (2, 7, "new"), (3, 1, "d")}


def test_state_helpers(spark, tmp_path):
    import datetime

    day = datetime.date(2024, 1, 10)
    assert [state.run_mode(a, day, b) for a, b in ((None, True), (day, False), (day, True), (datetime.date(2024, 1, 1), True))] == ["fresh", "fresh", "skip", "update"]
    tries = []

    def fails():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 7

    assert state.with_retry(fails, first_wait=0) == 7
    with pytest.raises(OSError):
        state.with_retry(lambda: (_ for _ in ()).throw(OSError()), 2, 0)
    a = spark.createDataFrame([(1, 3, "x"), (1, 3, "y"), (2, None, None), (None, 1, "z")], "k int, v int, x string")
    once = {tuple(r) for r in state.pick_latest(a, ["k"], "v").collect()}
    assert len(once) == 3 and {(2, None, None), (None, 1, "z")} < once
    assert {tuple(r) for r in state.upsert_newer(a, a, ["k"], "v").collect()} == once
    assert readers.merged_settings({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 3}, "d": [2], "e": 1}) == {"a": {"b": 3, "c": 2}, "d": [2], "e": 1}


def test_archives(spark):
    import io
    import zipfile

    import numpy as np

    doc = '<?xml version="1.0"?><us-patent-grant><publication-reference><document-id><country>US</country><doc-number>0{n}</doc-number><kind>B2</kind><date>2020{m}01</date></document-id></publication-reference><invention-title>T <i>x</i></invention-title><abstract><p>One</p></abstract><claims><claim>c1</claim><claim>c2</claim></claims></us-patent-grant>\n'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.xml", doc.format(n=11, m="01") + doc.format(n=12, m="99") + '<?xml version="1.0"?><broken>')
        z.writestr("readme.txt", "no")
    files = spark.createDataFrame([("a", out.getvalue()), ("b", b"no zip"), ("c", None)], "path string, content binary")
    rows = sorted(readers.patent_zips(files).collect())
    assert [(r.patent_number, r.title, r.abstract, r.claims, str(r.publication_date)) for r in rows] == [("US-11-B2", "T x", "One", ["c1", "c2"], "2020-01-01"), ("US-12-B2", "T x", "One", ["c1", "c2"], "None")]
    out = io.BytesIO()
    np.savez(out, vectors=np.arange(6).reshape(3, 2), ids=np.array(["a", "b", "c"]))
    got = readers.npz_matrix(spark.createDataFrame([("m", out.getvalue())], "path string, content binary")).collect()
    assert [(r.key, r.vector) for r in got] == [("a", [0.0, 1.0]), ("b", [2.0, 3.0]), ("c", [4.0, 5.0])]


def test_running_numbers(spark):
    rows = [(i * 7 % 50, None if i % 9 == 0 else f"x{i % 4}") for i in range(50)]
    df = spark.createDataFrame(rows, "id int, s string").repartition(5)
    got = {r.id: r.number for r in running_number(df, ["s", "id"]).collect()}
    assert got == {i: n for n, (i, _s) in enumerate(sorted(rows, key=lambda r: (r[1] or "", r[0])))}
    assert running_number(df.limit(0), ["s", "id"]).count() == 0
    sums = {r.id: r.t for r in running_sum(df, ["id"], "id", "t").collect()}
    assert sums == {i: i * (i + 1) // 2 for i in range(50)}
