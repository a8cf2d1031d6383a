"""Text expressions; all are Column to Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that end an assignee, and 'and' left over before them.
LEGAL_ENDS = "inc|incorporated|corp|corporation|co|company|ltd|limited|llc|lp|llp|plc|ag|gmbh|mbh|sa|nv|kg|kgaa|ab|oy|oyj|spa|bv|pty|pte|srl|aps|as|kk|ulc|pc|pllc|sas|sl|lda|and"
# Names that the rules cannot bring together.
ALIASES = {"E I Du Pont De Nemours": "Du Pont", "Du Pont De Nemours": "Du Pont", "Amira Phamaceuticals": "Amira Pharmaceuticals"}


def clean_text(c: Column) -> Column:
    """White space runs to one blank, then tags, then web addresses removed, then trimmed; null becomes ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    c = F.regexp_replace(c, "<[^>]+>", "")
    return F.trim(F.regexp_replace(c, r"https?://\S+|www\.\S+", ""))


def sentence_chunks(c: Column, most: int) -> Column:
    """ARRAY<STRING>: the text itself if short enough, else its sentences packed greedily, joined by '. ', a new chunk
    where the next would make it longer than ``most``. A single longer sentence stays whole; null gives an empty array."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        cur = acc["cur"]
        opens = (cur != "") & (F.length(cur) + F.length(s) + 1 > most)
        return F.struct(
            F.when(opens, F.array_append(acc["done"], cur)).otherwise(acc["done"]).alias("done"),
            F.when((cur == "") | opens, s).otherwise(F.concat(cur, F.lit(". "), s)).alias("cur"),
        )

    parts = F.filter(F.transform(F.split(c, "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")
    packed = F.aggregate(parts, start, step, lambda acc: F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]))
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.length(c) <= most, F.array(c)).otherwise(packed)


def searchable_text(title: Column, *bodies: Column) -> Column:
    """The title twice, then the bodies; nulls leave no gap."""
    return F.concat_ws(" ", title, title, *bodies)


def canonical_assignee(c: Column) -> Column:
    """One spelling for an assignee: a country in brackets at the end dropped, '&' as 'and', full stops, commas, underlines
    and hyphens as blanks, legal forms at the end removed as often as they stand there, each word capitalised, then the
    aliases. Null becomes ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\([A-Za-z]{2}\)\s*$", "")
    c = F.regexp_replace(F.regexp_replace(c, "&", " and "), "[._,-]", " ")
    c = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    c = F.trim(F.regexp_replace(c, f"((^| )({LEGAL_ENDS}))+$", ""))
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"))
    out = F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")
    named = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(named[out], out)


def code_class(c: Column) -> Column:
    """The first four characters of a classification code without blanks."""
    return F.substring(F.replace(c, F.lit(" "), F.lit("")), 1, 4)


def accession(header: Column) -> Column:
    """The accession of 'db|ACC|ENTRY', 'ACC|ENTRY' or 'ACC'."""
    first = F.split(F.regexp_replace(header, "^>", ""), " ")[0]
    parts = F.split(first, r"\|")
    return F.when(F.size(parts) >= 3, parts[1]).otherwise(parts[0])


def compact_number(number: Column) -> Column:
    """'US-123-A1' as 'US123': without dashes and kind."""
    return F.regexp_replace(F.regexp_replace(number, r"-[A-Z]\d?$", ""), "-", "")


def short_date(c: Column) -> Column:
    """YYMMDD as a date; years from 90 on are of the last century. Anything else is null."""
    year = F.substring(c, 1, 2).cast("int")
    full = F.concat(F.when(year >= 90, "19").otherwise("20"), c)
    return F.when(c.rlike("^[0-9]{6}$"), F.try_to_timestamp(full, F.lit("yyyyMMdd")).cast("date"))


def mentions(body: Column, symbol: Column) -> Column:
    """Whether a symbol stands in the body as a word of its own."""
    return F.concat(F.lit(" "), F.regexp_replace(body, "[^A-Za-z0-9-]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), symbol, F.lit(" ")))
