"""Expressions on records: identifiers, coercion, formatted texts, small vectors. Column to Column, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.hashing import point_id

# Fixed value: an atom of a SMILES string, but for hydrogen in brackets.
ATOM = r"\[[^\]]*\]|Cl|Br|[BCNOPSFIbcnops]"


def heavy_atoms(smiles: Column) -> Column:
    """Atoms other than hydrogen of a SMILES string; null stays null."""
    atoms = F.regexp_extract_all(smiles, F.lit(f"({ATOM})"))
    return F.size(F.filter(atoms, lambda a: ~a.rlike(r"^\[[0-9]*H[0-9+-]*\]$")))


def numbered(ident: Column, prefix: str = "SCHEMBL") -> Column:
    """The number of an id with a prefix; null if it is not of that form."""
    return F.regexp_extract(ident, f"^{prefix}([0-9]{{1,18}})$", 1).try_cast("bigint")


def query_text(gene: Column, name: Column) -> Column:
    """The gene and what stands before the first bracket of the name."""
    return F.trim(F.concat_ws(" ", gene, F.trim(F.substring_index(name, "(", 1))))


def shortened(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def first_claims(claims: Column, n: int = 3, most: int = 2000) -> Column:
    """The first n claims in one text of at most ``most`` characters, marked where it was cut."""
    return shortened(F.array_join(F.slice(claims, 1, n), " "), most)


def titled_abstract(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nAbstract: "), abstract)


def whole_number(text: Column) -> Column:
    """'123.0' and '123' as 123; anything else null."""
    return F.floor(text.try_cast("double")).cast("bigint")


def plain_number_text(text: Column) -> Column:
    """'123.0' as '123'; 'nan' and null as ''."""
    return F.when(text.isNull() | (F.lower(text) == "nan"), F.lit("")).otherwise(F.regexp_replace(text, r"\.0$", ""))


def compact_date(text: Column) -> Column:
    """The first eight-digit date in a text, such as the name of a file; null if there is none."""
    return F.try_to_timestamp(F.regexp_extract(text, r"(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")


def all_dates(json: Column) -> Column:
    """Every eight-digit date anywhere in a JSON text, at any depth, in ascending order, each once."""
    found = F.regexp_extract_all(json, F.lit(r'"((?:19|20)\d{6})"'))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda d: F.try_to_timestamp(d, F.lit("yyyyMMdd")).cast("date")), lambda d: d.isNotNull())))


def first_id(**ids: Column) -> Column:
    """The 63-bit id of the first id that is not null, in the order given, with its kind before it."""
    return F.coalesce(*[F.when(c.isNotNull(), point_id(F.concat(F.lit(f"{kind}:"), c.cast("string")))) for kind, c in ids.items()])


def list_hash(*parts: Column | tuple[Column]) -> Column:
    """SHA-256 of values one after another; lists (given as 1-tuples) sorted and joined by '|', nulls as ''."""
    text = [F.coalesce(F.array_join(F.array_sort(p[0]), "|"), F.lit("")) if isinstance(p, tuple) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*text), 256)


# Parts of protein class paths and the family each stands for; the first one found counts, and the order is
# also that in which families win where several targets share a gene.
FAMILIES = (
    ("/Enzyme/Kinase", "Kinase"),
    ("/Enzyme/Protease", "Protease"),
    ("G protein-coupled receptor", "GPCR"),
    ("/Ion channel", "Ion channel"),
    ("/Transcription factor/Nuclear receptor", "Nuclear receptor"),
    ("/Transporter", "Transporter"),
    ("/Epigenetic regulator", "Epigenetic regulator"),
    ("/Membrane receptor", "Membrane receptor (other)"),
    ("/Enzyme", "Other enzyme"),
    ("/Transcription factor", "Transcription factor (other)"),
)
CLASSIFIED, UNCLASSIFIED = "Other (classified)", "Other/unclassified"


def family_place(paths: Column) -> Column:
    """The place in the order of families (from 0) of a target with these class paths; no path, or one that says
    'Unclassified', comes last."""
    every = F.coalesce(F.array_join(paths, " ;; "), F.lit(""))
    found = F.array_position(F.array(*[every.contains(part) for part, _name in FAMILIES]), True)
    other = F.when((every != "") & ~every.contains("Unclassified"), len(FAMILIES)).otherwise(len(FAMILIES) + 1)
    return F.when(found > 0, found - 1).otherwise(other).cast("int")


def family_name(place: Column) -> Column:
    names = [*(name for _part, name in FAMILIES), CLASSIFIED, UNCLASSIFIED]
    return F.element_at(F.array(*map(F.lit, names)), place + 1)


def turned(templates: list[str], number: Column, value: Column) -> Column:
    """The templates in turn, with ``{}`` replaced by the value."""
    return F.replace(F.element_at(F.array(*map(F.lit, templates)), (number % len(templates) + 1).cast("int")), F.lit("{}"), value)


def word_vector(text: Column, dim: int = 32) -> Column:
    """Counts of a text's words by the hash of each: a stand-in for a text encoder that needs no model."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    at = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("double"))


def mean_pool(vectors: Column, dim: int) -> Column:
    """The mean of token vectors without the first and the last one (marks of begin and end); null if none is left."""
    inner = F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 2, F.lit(0)))
    total = F.aggregate(inner, F.array_repeat(F.lit(0.0), dim), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(inner) > 0, F.transform(total, lambda x: x / F.size(inner)))


def kmer_counts(sequence: Column, letters: str) -> Column:
    """Counts of the single letters and of all pairs of ``letters`` in a sequence, centred and of length 1 (zero if all
    counts are equal)."""
    grams = [*letters, *(a + b for a in letters for b in letters)]
    singles = F.split(sequence, "")
    n = F.length(sequence)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(sequence, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    both = F.concat(singles, pairs)
    counts = F.transform(F.array(*map(F.lit, grams)), lambda g: F.size(F.filter(both, lambda x: x == g)).cast("double"))
    mean = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x) / len(grams)
    centred = F.transform(counts, lambda x: x - mean)
    size = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(centred, lambda x: x / size)).otherwise(centred)


def identity(a: Column, b: Column) -> Column:
    """Share of equal places of two sequences under the best alignment by edits; 0 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def log_sum_exp(x: Column) -> Column:
    """An aggregate: ln of the sum of exp, stable for large values."""
    top = F.max(x)
    return F.aggregate(F.collect_list(x), F.lit(0.0), lambda s, v: s + F.exp(v - top), lambda s: top + F.log(s))
