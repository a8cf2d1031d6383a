"""The read side: collections by name, with query, count, predict, provenance, similar and lookups. All arguments but the
collection are keywords; unknown collections, fields and missing vectors raise ValueError."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import scores
from orrery.functions.filters import compile_filter
from orrery.operators import provenance as prov
from orrery.operators import transfer

MAX_LIMIT = 100
MODALITIES = {"chemical": (2048, "tanimoto"), "text": (768, "cosine"), "protein": (1280, "cosine")}


@dataclass
class Collection:
    """Rows with an ``id``, payload fields and, where it can be searched, a ``vector``."""

    rows: DataFrame
    modality: str
    dim: int | None = None


class Engine:
    """collections: name to Collection; labels: (rid, label); targets: (label, gene, name, org)."""

    def __init__(self, spark: SparkSession, collections: dict[str, Collection], labels: DataFrame | None = None, targets: DataFrame | None = None, encoders: dict | None = None, names: DataFrame | None = None):
        self.spark, self._all, self.labels, self.targets, self.encoders, self.names = spark, collections, labels, targets, encoders or {}, names

    def collections(self) -> DataFrame:
        rows = [(n, c.modality, c.dim or MODALITIES[c.modality][0]) for n, c in self._all.items()]
        return self.spark.createDataFrame(rows, "name string, modality string, dim int")

    def _collection(self, name: str) -> Collection:
        if name not in self._all:
            raise ValueError(f"unknown collection {name}")
        return self._all[name]

    def _vector(self, c: Collection, text, vector, like) -> list | None:
        if vector is not None:
            return list(vector)
        if text is not None:
            if c.modality not in self.encoders:
                raise ValueError(f"no encoder for {c.modality} is installed")
            return list(self.encoders[c.modality](text))
        if like is not None:
            row = c.rows.filter(F.col("id") == like).select("vector").first()
            if row is None or row.vector is None:
                raise ValueError(f"{like} has no vector")
            return list(row.vector)
        return None

    def query(self, collection: str, *, ids: list | None = None, text: str | None = None, vector: list | None = None, like=None, filter: dict | None = None, limit: int = 10, offset: int = 0, after=None) -> DataFrame:  # noqa: A002
        """By ids; else the rows most similar to a text, vector or stored row, with score; else a page by id, from the
        first id beyond ``after``. The filter comes before the search. limit is kept within 1..100."""
        c = self._collection(collection)
        n = max(1, min(int(limit), MAX_LIMIT))
        payload = c.rows.drop("vector")
        if ids is not None:
            return payload.filter(F.col("id").isin([int(i) if isinstance(i, str) and i.isdigit() else i for i in ids]))
        kept = c.rows.filter(compile_filter(c.rows, filter))
        target = self._vector(c, text, vector, like)
        if target is None:
            rows = kept.drop("vector")
            return (rows.filter(F.col("id") > after) if after is not None else rows).orderBy("id").limit(n)
        # each partition keeps its best rows; only these are merged
        return self._scored(kept, c.modality, target).withColumn("score", F.round("score", 12)).orderBy(F.col("score").desc(), "id").limit(n + int(offset)).offset(int(offset)).drop("vector").withColumn("score", F.round("score", 4))

    @staticmethod
    def _scored(rows: DataFrame, modality: str, target: list) -> DataFrame:
        """Rows with a vector and its similarity to one vector, as an expression of that literal."""
        rows = rows.filter(F.col("vector").isNotNull())
        measure = scores.tanimoto if MODALITIES[modality][1] == "tanimoto" else scores.cosine
        kind = dict(rows.dtypes)["vector"]
        return rows.withColumn("score", F.coalesce(measure(F.lit(list(target)).cast(kind), F.col("vector")), F.lit(0.0)))

    def count(self, collection: str, *, filter: dict | None = None) -> int:  # noqa: A002
        rows = self._collection(collection).rows
        return rows.filter(compile_filter(rows, filter)).count()

    def predict(self, reference: str, *, vector: list, top: int = 10, human_only: bool = True, floor: float = 0.3, known: list[str] | None = None) -> DataFrame:
        """Labels of one fingerprint: (label, gene, name, conf, support, band, known), best first; unknown organisms stay.
        Labels in ``known`` are kept below the floor too."""
        c = self._collection(reference)
        near = self._scored(c.rows.select("id", "vector"), c.modality, vector).withColumn("sim", F.round("score", 12)).filter("sim >= 0.3").orderBy(F.col("sim").desc(), "id").limit(20)
        # at most twenty rows
        near = near.select(F.lit(0).alias("qid"), F.col("id").alias("rid"), "sim").withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("sim").desc(), "rid")))
        ranked = transfer.transfer_labels(near, self.labels)
        named = ranked.join(self.targets, "label", "left").withColumn("known", F.col("label").isin(list(known or [])))
        if human_only:
            named = named.filter("org is null or org like '%Homo sapiens%'")
        out = named.filter((F.col("conf") >= floor) | F.col("known")).orderBy("rk").limit(max(1, min(int(top), MAX_LIMIT)))
        return out.select("label", "gene", "name", F.round("conf", 3).alias("conf"), "support", scores.confidence_band(F.col("conf")).alias("band"), "known")

    def name(self, *, key: str, parts: list[str] | None = None, prefix: int = 14) -> str | None:
        """The name of a key, else of its first ``prefix`` characters, else of the keys of its parts, tried in their order
        in the same way; None if nothing is known. ``names`` is (key, name)."""
        if self.names is None:
            raise ValueError("no names are there")
        wanted = [key, *(parts or [])]
        heads = list(dict.fromkeys(k[:prefix] for k in wanted))
        near = self.names.filter(F.substring("key", 1, prefix).isin(heads) & F.col("name").isNotNull())
        # the least name of each whole key and, in case none has one, of each head
        whole = {r.key: r.n for r in near.filter(F.col("key").isin(wanted)).groupBy("key").agg(F.min("name").alias("n")).collect()}
        head = {r.h: r.n for r in near.groupBy(F.substring("key", 1, prefix).alias("h")).agg(F.min_by("name", "key").alias("n")).collect()}
        return next((n for k in wanted if (n := whole.get(k) or head.get(k[:prefix]))), None)

    def provenance(self, links: DataFrame, records: DataFrame, *, ids: list, most: int = 8) -> DataFrame:
        return prov.provenance(links.filter(F.col("item").isin(ids)), records, most)

    def similar(self, collection: str, *, id, limit: int = 10, labels: str | None = None) -> DataFrame:  # noqa: A002
        """Nearest rows of a stored row without itself, and what labels they share, in its own order."""
        c = self._collection(collection)
        own = c.rows.filter(F.col("id") == id)
        near = self.query(collection, like=id, limit=min(int(limit) + 1, MAX_LIMIT)).filter(F.col("id") != id).limit(int(limit))
        if labels is None:
            return near
        mine = own.select(F.col(labels).alias("_own"))
        return near.join(F.broadcast(mine)).withColumn("shared", F.filter("_own", lambda x: F.array_contains(F.col(labels), x))).drop("_own")  # one row

    def known_labels(self, *, id) -> list[str]:  # noqa: A002
        return sorted(r.label for r in self.labels.filter(F.col("rid") == id).select("label").distinct().collect())
