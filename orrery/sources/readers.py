"""Readers of the file kinds the collections come from; all give DataFrames with a fixed schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HIT_SCHEMA = "query_id string, target_id string, identity double, alignment_length int, mismatches int, gap_opens int, q_start int, q_end int, s_start int, s_end int, evalue double, bitscore double"


def key_value_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(cid, smiles) of a header-less TSV; only rows whose key is all digits."""
    t = spark.read.csv(path, sep="\t", schema="key string, smiles string")
    return t.filter(F.col("key").rlike("^[0-9]+$")).select(F.col("key").cast("bigint").alias("cid"), "smiles")


def label_map_json(spark: SparkSession, path: str) -> DataFrame:
    """(cid, label) of a JSON object of arrays, one row per pair."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return doc.select(F.explode("m").alias("key", "labels")).select(F.col("key").cast("bigint").alias("cid"), F.explode("labels").alias("label"))


def wrapped_json(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Rows of {"field": [row, ...]} or of a bare array."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    inner = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", f"$.{field}"))
    return text.select(F.explode(F.from_json(inner, f"array<struct<{schema}>>")).alias("x")).select("x.*")


def json_lines(spark: SparkSession, path: str, schema: str, text: str = "text") -> DataFrame:
    """JSON lines; blank lines and rows without text are skipped."""
    return spark.read.schema(schema).json(path).filter(F.length(text) > 0)


def pipe_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A pipe-delimited table with a header; quoted fields may span lines."""
    return spark.read.csv(path, sep="|", header=True, schema=schema, multiLine=True, escape='"')


def articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract) of PubmedArticle records, plain or gzipped; all parts of a structured abstract, in order.
    Records without pmid or abstract are left out."""
    part = "array<struct<_VALUE: string>>"
    t = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(f"MedlineCitation struct<PMID: struct<_VALUE: string>, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: {part}>>>").option("attributePrefix", "_a_").load(path)
    c = F.col("MedlineCitation")
    body = F.array_join(F.transform(c["Article"]["Abstract"]["AbstractText"], lambda x: x["_VALUE"]), " ")
    return t.select(c["PMID"]["_VALUE"].alias("pmid"), c["Article"]["ArticleTitle"].alias("title"), body.alias("abstract")).filter("pmid is not null and abstract <> ''")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, entry, taxid, sequence) of FASTA records; the accession is the second of 'db|ACC|ENTRY'."""
    t = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("rec")).filter("trim(rec) <> ''")
    head = F.split("rec", "\n", 2)
    names = F.split(F.split(head[0], " ")[0], r"\|")
    return t.select(
        F.when(F.size(names) >= 3, names[1]).otherwise(names[0]).alias("accession"),
        F.when(F.size(names) >= 3, names[2]).alias("entry"),
        F.expr("try_cast(nullif(regexp_extract(split(rec, '\n', 2)[0], 'OX=([0-9]+)', 1), '') as int)").alias("taxid"),
        F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s+", "").alias("sequence"),
    )


def alignment_hits(spark: SparkSession, path: str, least_identity: float = 0.0) -> DataFrame:
    """Twelve-column alignment rows without hits of a query to itself and under an identity."""
    return spark.read.csv(path, sep="\t", schema=HIT_SCHEMA).filter((F.col("query_id") != F.col("target_id")) & (F.col("identity") >= least_identity))


def id_set(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one per line, plain or gzipped; blank and comment lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> '' and not startswith(id, '#')").distinct()


def labelled_csv(spark: SparkSession, path: str, text: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row of counts): rows whose label is a number, and how many were read and dropped."""
    raw = spark.read.csv(path, header=True)
    t = raw.select(F.col(text).alias("text"), F.expr(f"try_cast(`{label}` as double)").alias("label"))
    good = t.filter("text is not null and trim(text) <> '' and label is not null")
    return good, t.agg(F.count(F.lit(1)).alias("n_read"), F.count_if(F.col("text").isNull() | (F.trim("text") == "") | F.col("label").isNull()).alias("n_bad"))


PATENT_SCHEMA = "patent_number string, title string, abstract string, claims array<string>, description string, country string, publication_date date"


def _text(node) -> str:
    """The text of a node and all its descendants, white space squeezed."""
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _patent_row(xml: bytes) -> tuple | None:
    """The fields of one patent document; None for anything that is not one, has no number or neither title nor text."""
    import datetime
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    ident = root.find(".//publication-reference/document-id")
    if ident is None or not (number := _text(ident.find("doc-number")).lstrip("0")):
        return None
    country, kind, day = (_text(ident.find(t)) for t in ("country", "kind", "date"))
    title, abstract, description = (_text(root.find(t)) for t in (".//invention-title", ".//abstract", ".//description"))
    if not (title or abstract):
        return None
    try:
        date = datetime.datetime.strptime(day, "%Y%m%d").date()
    except ValueError:
        date = None
    claims = [t for c in root.iterfind(".//claim") if (t := _text(c))]
    return "-".join(x for x in (country, number, kind) if x), title or None, abstract or None, claims, description or None, country or None, date


def patent_zips(files: DataFrame) -> DataFrame:
    """Patents (PATENT_SCHEMA) in archives (path, content BINARY) of files in which XML documents stand one after
    another. Documents that cannot be parsed, and archives that are none, give no rows. One document is held at a time,
    besides the file it stands in. ``spark.read.format("binaryFile")`` gives such archives."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            rows = []
            for content in batch.column("content"):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                except zipfile.BadZipFile:
                    continue
                for name in archive.namelist():
                    if name.lower().endswith(".xml"):
                        docs = re.split(rb"(?=<\?xml )", archive.read(name))
                        rows += [r for d in docs if d.strip() and (r := _patent_row(d.strip()))]
            fields = list(zip(*rows)) if rows else [[] for _ in range(7)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.date32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(f), k) for f, k in zip(fields, kinds)], [c.split()[0] for c in PATENT_SCHEMA.split(", ")])

    return files.select("content").mapInArrow(run, PATENT_SCHEMA)


def nested_patents(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(patent_number, title, abstract, country, publication_date) of patents nested in JSON files anywhere under
    ``path``: {"patent": {"id": {"country", "number", "kind"}, "text": {"title", "abstract"}, "published": "YYYYMMDD"}}.
    Only numbers in ``ids`` (id), if given; rows without title and abstract are left out, later copies of a number too.
    """
    inner = "id struct<country: string, number: string, kind: string>, text struct<title: string, abstract: string>, published string"
    t = spark.read.option("recursiveFileLookup", "true").schema(f"patent struct<{inner}>").json(path).select("patent.*", F.input_file_name().alias("file"))
    number = F.concat_ws("-", "id.country", "id.number", "id.kind")
    rows = t.select(number.alias("patent_number"), "text.title", "text.abstract", "id.country", F.try_to_timestamp("published", F.lit("yyyyMMdd")).cast("date").alias("publication_date"), "file")
    rows = rows.filter("patent_number <> '' and (title is not null or abstract is not null)")
    if ids is not None:
        rows = rows.join(ids.select(F.col("id").alias("patent_number")).distinct(), "patent_number", "left_semi")
    first = F.min_by(F.struct("title", "abstract", "country", "publication_date"), F.struct("file", F.xxhash64("title", "abstract")))
    return rows.groupBy("patent_number").agg(first.alias("x")).select("patent_number", "x.*")


def vectors_with_sidecar(vectors: DataFrame, sidecar: DataFrame, position: str = "position") -> DataFrame:
    """Vectors and the rows that describe them, joined by position; rows that stand alone on either side are left out."""
    return vectors.join(sidecar, position)


def npz_matrix(files: DataFrame, name: str = "vectors", keys: str = "ids") -> DataFrame:
    """(key STRING, vector ARRAY<FLOAT>) of archives (path, content BINARY) of NumPy arrays: a matrix and its row names."""

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as z:
                    m, k = z[name].astype(np.float32), z[keys].astype(str)
                for i in range(0, len(m), 4096):
                    part = m[i : i + 4096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * m.shape[1]), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 4096].tolist(), pa.string()), lists], ["key", "vector"])

    return files.select("content").mapInArrow(run, "key string, vector array<float>")


def merged_settings(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``: mappings are merged at every depth, everything else is replaced."""
    return base | {k: merged_settings(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def _array_items(read, field: str | None, size: int):
    """The texts of the items of a JSON array, read in pieces by ``read(n)``: the array that is the whole document, else the
    value of ``field`` of an object on the outermost level. Only one item, and a piece, is held."""
    import codecs
    import json

    decoder, utf8 = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8-sig")()
    between = re.compile(r"[ \t\r\n,:]*")
    text, at, ended = "", 0, False

    def more() -> bool:
        nonlocal text, at, ended
        if ended:
            return False
        piece = read(size)
        ended = not piece
        text, at = text[at:] + utf8.decode(piece, ended), 0
        return not ended

    def ahead() -> str:
        """The next character that says something, which is not consumed; '' at the end."""
        nonlocal at
        while True:
            at = between.match(text, at).end()
            if at < len(text) or not more():
                return text[at : at + 1]

    def value() -> tuple:
        """The next value and its text; more is read until the value ends before what was read does."""
        nonlocal at
        ahead()
        while True:
            try:
                out, end = decoder.raw_decode(text, at)
                # a number may go on behind what looks like its end
                if text[end : end + 1] in tuple(" \t\r\n,:]}") or not more():
                    item, at = text[at:end], end
                    return out, item
            except json.JSONDecodeError:
                if not more():
                    raise

    if ahead() == "{":
        at += 1
        while ahead() not in ("}", "") and value()[0] != field:
            value()  # of another field
    if ahead() != "[":
        return
    at += 1
    while (c := ahead()) != "]":
        if not c:
            raise ValueError("the array does not end")
        yield value()[1]


def json_array_stream(spark: SparkSession, path: str, field: str, schema: str, piece: int = 1 << 20) -> DataFrame:
    """Rows of {"field": [row, ...]} or of a bare array, as ``wrapped_json``, but a file is read piece by piece and its rows
    pass by one at a time, so a file may be larger than memory. Files that hold neither give no rows; a broken one raises.
    Every executor must be able to open the files; those of one folder are read side by side."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().toString() for x in fs.globStatus(root) or [] for x in (fs.listStatus(x.getPath()) if x.isDirectory() else [x])]
    files = spark.createDataFrame([(n,) for n in names if n.rsplit("/", 1)[1][0] not in "._"], "file string").repartition(max(1, len(names)))

    def run(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        for batch in batches:
            for name in batch.column("file").to_pylist():
                system, where = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", name))
                with system.open_input_stream(where) as f:
                    rows = []
                    for item in _array_items(f.read, field, piece):
                        rows.append(item)
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
                            rows = []
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    return files.mapInArrow(run, "value string").select(F.from_json("value", f"struct<{schema}>").alias("x")).select("x.*")
