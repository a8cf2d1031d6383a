"""Variant spellings of names typed by people: which strings name the same organisation or person.

A name is parsed into what it says (kind of organisation, own words, or surname and given names); the own words or the
surname are its key. Keys within a small edit distance are found by a pigeonhole segment join among organisations of one
kind and persons of one initial. Organisations are linked by their keys, persons by surname and given name together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.components import connected_components
from orrery.session import cut

# Words that say what kind an organisation is, with their usual short forms.
KIND_WORDS = {
    "university": "university universities univ u uni",
    "hospital": "hospital hospitals hosp",
    "medical": "medical med",
    "center": "center centre centers ctr cent",
    "institute": "institute institut inst",
    "technology": "technology technologies technol tech",
    "national": "national natl nat",
    "research": "research rsch res",
    "society": "society soc",
    "oncology": "oncology oncol onc",
    "foundation": "foundation found fdn fndn",
    "chemicals": "chemicals chemical chems chem",
    "international": "international intl",
    "biosciences": "biosciences bioscience biosci",
    "pharmaceuticals": "pharmaceuticals pharmaceutical pharmacs pharms pharma pharm",
    "diagnostics": "diagnostics diagnostic diagn diag dx",
    "therapeutics": "therapeutics therapeutic therap tx",
    "laboratories": "laboratories laboratory labs lab",
    "college": "college coll",
    "school": "school sch",
    "department": "department dept",
    "group": "group grp",
    "holdings": "holdings holding",
    "industries": "industries industry ind",
    "systems": "systems system",
    "academy": "academy acad",
    "association": "association assoc assn",
}
# Legal forms, titles and joining words, which tell no two names apart.
LEGAL_FORMS = "inc incorporated corp corporation ltd limited llc llp lp co company plc gmbh ag sa sas sarl spa srl nv bv ab oy kg kk pty as".split()
SILENT_WORDS = "the of and for a an dr prof mr mrs ms sir phd md".split()
# Short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sandy al", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben", "catherine": "cathy", "charles": "charlie chuck",
    "charlotte": "lottie charlie", "christopher": "chris", "daniel": "dan danny", "david": "dave", "deborah": "debbie", "edward": "ted ed eddie ned",
    "elizabeth": "liz beth betty lizzie eliza", "francisco": "paco pancho", "friedrich": "fritz", "gregory": "greg", "henry": "hank harry", "ignacio": "nacho",
    "james": "jim jimmy", "jennifer": "jenny jen", "johannes": "hans", "john": "jack johnny", "jose": "pepe", "joseph": "joe", "katherine": "kate kathy katie kitty",
    "kenneth": "ken", "lawrence": "larry", "margaret": "peggy meg maggie", "maria": "mia", "matthew": "matt", "michael": "mike mick", "nicholas": "nick nicky",
    "pamela": "pam", "patricia": "pat patty", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "dick rick", "robert": "bob rob bobby",
    "ronald": "ron", "samuel": "sam", "stephen": "steve", "steven": "steve", "susan": "sue susie", "theodore": "theo", "thomas": "tom tommy", "timothy": "tim",
    "victoria": "vicky vicki tori", "vladimir": "volodya", "walter": "walt", "william": "bill will billy",
}

KIND_OF = {short: word for word, shorts in KIND_WORDS.items() for short in shorts.split()}
FULL_GIVEN = {}
for _full, _shorts in NICKNAMES.items():
    for _short in _shorts.split():
        FULL_GIVEN.setdefault(_short, _full)
_QUIET = {*LEGAL_FORMS, *SILENT_WORDS}
_AFTER_LETTER = "|".join(w for w in KIND_OF if len(w) > 2)
_LONG_KINDS = sorted((w for w in KIND_OF if len(w) > 5), key=len, reverse=True)


def _plain(text: str) -> str:
    """Without accents; letters with no decomposition stay."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _loosen(word: str) -> list[str]:
    """A word in which kind words were run together with others ('medicalcenter', 'kinonhospital') in its parts."""
    if len(word) < 10 or word in KIND_OF:
        return [word]
    for kind in _LONG_KINDS:
        if word.startswith(kind):
            return [kind, *_loosen(word[len(kind) :])]
        if word.endswith(kind):
            return [*_loosen(word[: -len(kind)]), kind]
    return [word]


def _one_off(a: str, b: str) -> bool:
    """Whether one inserted, missing, other or exchanged letter makes a into b."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


@lru_cache(100_000)
def _kind(word: str) -> str:
    """The kind word meant: itself, or the one that a long word is one letter away from."""
    if len(word) < 8 or word in KIND_OF:
        return word
    return next((k for k in _LONG_KINDS if k[0] == word[0] and abs(len(k) - len(word)) < 2 and _one_off(k, word)), word)


def _unhyphenated(text: str) -> str:
    """Kind words written with a hyphen ('bio-sciences') in one word."""
    return re.sub(r"\b([a-z]+)-([a-z]+)\b", lambda m: m[1] + m[2] if m[1] + m[2] in KIND_OF and m[1] not in KIND_OF else m[0], text)


def parse_name(name: str) -> tuple[str, list[str], str, str, str, str]:
    """(domain, keys, given, middle, acronym, firm).

    domain: 'org:' and the sorted kind words; 'person'; or 'acronym' for a bare acronym. keys: the own words without
    blanks, in both orders if there are two, resp. the surname. given: the given name in full form, or one initial.
    firm: for a word followed by two letters that may be initials or a legal form ('Bauer AG'), the key it has as a firm.
    Names of unknown kind are firms if a legal form or at least four words say so, else persons. A string without letters
    or digits has the domain 'none' and no keys.
    """
    text = re.sub(r"\[[^\]]*\]", " ", _plain(name))
    acronym = ""
    for inner in re.findall(r"\(([^)]*)\)", text):
        if re.fullmatch(r"[A-Za-z]{3,8}", inner.strip()):
            acronym = inner.strip().upper()
    text = re.sub(r"\([^)]*\)", " ", text).strip()
    if re.fullmatch(r"[A-Z]{3,6}", text):
        return "acronym", [text], "", "", text, ""
    text = re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})", " ", text)  # a blank lost between two capitalised words
    comma = re.match(r"\s*([^\s,]+)\s*,", re.sub(r"['`’]", "", text))
    # 'S. A.' and 'G.m.b.H.' at the end are legal forms, in front of a surname they are initials
    low = re.sub(r"\b(?:[a-z]\.\s?)+[a-z]\b\.?(?=\W*$)", lambda m: re.sub(r"[.\s]", "", m[0]), text.lower())
    low = _unhyphenated(re.sub(r"['`’]", "", low))
    words = [_kind(w) for t in re.findall(r"[^\W_]+", low) for w in _loosen(t)]
    kinds = sorted({KIND_OF[w] for w in words if w in KIND_OF and (len(w) > 1 or re.search(rf"\b{w}\b\.?\s+(?:of|{_AFTER_LETTER})\b|\s{w}\.\s*$", low))})
    if kinds:
        own = [w for w in words if w not in KIND_OF and w not in _QUIET]
        joined = "".join(own)
        if not joined:
            return "org:" + " ".join(kinds), [" ".join(kinds)], "", "", acronym, ""
        keys = [joined] + (["".join(own[::-1])] if len(own) == 2 and own[0] != own[1] else [])
        return "org:" + " ".join(kinds), keys, "", "", acronym, ""
    words = [w for w in words if w not in SILENT_WORDS or len(w) == 1]
    if not words:
        return "none", [], "", "", "", ""
    short = len(words) == 2 and len(words[1]) == 2 and words[1] in LEGAL_FORMS
    legal = [w for w in words if w not in LEGAL_FORMS] or words
    if not short and (len(legal) < len(words) and (words[-1] in LEGAL_FORMS or any(len(w) > 2 for w in words if w in LEGAL_FORMS)) or (len(words) > 3 and not comma and min(map(len, words)) > 1)):
        return "org:", ["".join(legal)] + (["".join(legal[::-1])] if len(legal) == 2 else []), "", "", acronym, ""
    surname, given, middle = (words[0], *words[1]) if short else _person(words, text, comma)
    return "person", [surname], given, middle, "", words[0] if short else ""


def _person(words: list[str], text: str, comma: re.Match | None) -> tuple[str, str, str]:
    """'Surname, Given M.', 'Surname GM', 'SURNAME GIVEN', 'G. M. Surname' and 'Given M. Surname'."""
    raw = re.findall(r"[^\W_]+", text)
    raw = [r for r in raw if r.lower() in words]
    if len(words) == 1:
        return words[0], "", ""
    if comma and _plain(comma[1]).lower().replace("-", "") in (words[0], "".join(words[:2])):
        surname, rest = words[0], words[1:]
    elif len(raw) == 2 and raw[1].isupper() and len(raw[1]) <= 2 and not raw[0].isupper():
        surname, rest = words[0], list(words[1])
    elif len(words) == 2 and raw and all(r.isupper() for r in raw) and (words[1] in _GIVEN or words[0] not in _GIVEN):
        surname, rest = words[0], words[1:]
    else:
        surname, rest = words[-1], words[:-1]
    given = FULL_GIVEN.get(rest[0], rest[0]) if rest else ""
    middle = rest[1][0] if len(rest) > 1 else ""
    return surname, given, middle


_GIVEN = {*NICKNAMES, *FULL_GIVEN}


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = pd.DataFrame([parse_name(n) for n in frame.name], columns=["domain", "keys", "given", "middle", "acronym", "firm"])
        out.insert(0, "name", frame.name.to_numpy())
        yield out


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of edits + 1 segments of nearly equal size; the last ones are the longer ones."""
    parts = edits + 1
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def _index_rows(edits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(d, len(k), i, k[at : at + n], k) for d, k in zip(frame.domain, frame.key) for i, (at, n) in enumerate(segments(len(k), edits))]
            yield pd.DataFrame(out, columns=["domain", "length", "part", "piece", "key"])

    return run


def _probe_rows(edits: int):
    """Substrings of a key that may be an indexed key's segment: a segment can have moved by at most the edits to its
    left, and what lies to its right must still fit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for d, k in zip(frame.domain, frame.key):
                m = len(k)
                for length in range(max(0, m - edits), m + 1):
                    gap = m - length
                    for i, (at, n) in enumerate(segments(length, edits)):
                        left = max(0, at - i, at + gap - (edits - i))
                        right = min(m - n, at + i, at + gap + (edits - i))
                        out += [(d, length, i, k[p : p + n], k) for p in range(left, right + 1)]
            yield pd.DataFrame(out, columns=["domain", "length", "part", "piece", "key"]).drop_duplicates()

    return run


def similar_keys(keys: DataFrame, edits: int = 2, one_from: int = 6, all_from: int = 9) -> DataFrame:
    """(domain, a, b): different keys of one domain that may be spellings of each other, each pair once.

    How much two keys may differ grows with the shorter one's length, as short names are close to each other by chance:
    from ``all_from`` characters on ``edits`` Levenshtein edits, from ``one_from`` on one, and at any length two
    exchanged letters.

    Pigeonhole: cut into edits + 1 segments, a key shares at least one segment with each such partner, moved by no more
    than the edits. Segments of all keys form an inverted index; position-shifted substrings look them up; the banded
    edit distance is checked inside the join, so candidates are never stored. Exchanged letters are found by the sorted
    letters of the keys too short for it.
    """
    # both sides are spread again by the piece before the join; a piece common to many keys is split by AQE
    schema = "domain string, length int, part int, piece string, key string"
    once = keys.select("domain", "key").distinct()
    found = _joined(once.filter(F.length("key") >= all_from), edits, schema)
    found = found.unionByName(_joined(once.filter(F.length("key").between(one_from, all_from)), 1, schema))
    letters = once.filter(F.length("key") < all_from).withColumn("letters", F.array_join(F.array_sort(F.split("key", "")), ""))
    a, b = letters.withColumnRenamed("key", "a"), letters.withColumnRenamed("key", "b")
    swapped = a.join(b, ["domain", "letters"]).filter((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 2) == 2)).select("domain", "a", "b")
    return found.unionByName(swapped).distinct()


def _joined(keys: DataFrame, edits: int, schema: str) -> DataFrame:
    index = keys.mapInPandas(_index_rows(edits), schema).withColumnRenamed("key", "b")
    probe = keys.mapInPandas(_probe_rows(edits), schema).withColumnRenamed("key", "a")
    near = F.levenshtein("a", "b", edits).between(1, edits)
    first = (F.length("a") > F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))
    pairs = probe.join(index, ["domain", "length", "part", "piece"]).filter(first & near)
    return pairs.select("domain", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tag(*parts) -> Column:
    return F.concat_ws("\u0001", *parts)


def name_entities(names: DataFrame, edits: int = 2) -> DataFrame:
    """(name, entity) for every string in ``names.name`` that has a key.

    Organisations of the same kind words with linked keys are one entity; legal forms, articles, places in brackets and
    the order of two own words do not matter. Persons need linked surnames and the same given name (nicknames in full
    form); a given name that occurs with one surname only may also be a misspelling, one edit away, of another one of
    that surname. Initials join the only person of a linked surname they fit, first one whose middle initial is known to
    agree. A bare acronym joins the only organisation whose spellings carry it in brackets, else it stands alone. A word
    with two letters that may be initials or a legal form is a person if another spelling of that surname and initial
    is, else a firm. Null, blank and unparsable strings are left out; repeats count once; an empty input gives an empty
    result.
    """
    once = names.select("name").filter("name is not null and trim(name) <> ''").distinct()
    parsed = cut(once.mapInPandas(_parse, "name string, domain string, keys array<string>, given string, middle string, acronym string, firm string").filter("domain <> 'none'"))
    people = parsed.filter("domain = 'person'").select("name", _tag(F.lit("p"), F.substring("given", 1, 1)).alias("domain"), F.col("keys")[0].alias("key"), "given", "middle", "firm")
    orgs = parsed.filter("startswith(domain, 'org:')").select("name", "domain", "keys", "acronym")
    firms = people.filter("firm <> ''").select("name", F.lit("org:").alias("domain"), F.array("firm").alias("keys"), F.lit("").alias("acronym"))
    # one search for all: own words by kind, surnames by initial, given names by surname
    givens = people.filter("length(given) > 5").select(_tag(F.lit("g"), "key").alias("domain"), F.col("given").alias("key"))
    keys = orgs.unionByName(firms).select("domain", F.explode("keys").alias("key")).unionByName(people.select("domain", "key")).unionByName(givens)
    near = cut(similar_keys(cut(keys.distinct()), edits))

    # links of organisations: near keys, and both orders of two words
    of = lambda kind: F.startswith("domain", F.lit(kind))
    links = near.filter(of("org:")).select(_tag("domain", "a").alias("a"), _tag("domain", "b").alias("b"))
    links = links.unionByName(orgs.filter("size(keys) > 1").select(_tag("domain", F.col("keys")[0]).alias("a"), _tag("domain", F.col("keys")[1]).alias("b")))
    # links of persons: near surnames with the same given name, resp. the same initials
    people = people.withColumn("tag", F.when(F.length("given") > 1, _tag(F.lit("g"), "given")).otherwise(_tag(F.lit("i"), "middle"))).withColumn("node", _tag("domain", "key", "tag"))
    spelled = people.select("domain", "key", "tag", "node").distinct()
    left = near.filter(of("p")).join(spelled.select("domain", F.col("key").alias("a"), "tag", F.col("node").alias("na")), ["domain", "a"])
    links = links.unionByName(left.join(spelled.select("domain", F.col("key").alias("b"), "tag", F.col("node").alias("nb")), ["domain", "b", "tag"]).select(F.col("na").alias("a"), F.col("nb").alias("b")))
    # and given names of one surname, one edit apart, of which one occurs with no other surname and is no known name
    one_edit = (F.levenshtein("a", "b", 1) >= 0) | (F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", "")))
    common = people.filter("length(given) > 5").groupBy("given").agg((F.min("key") == F.max("key")).alias("rare")).filter(F.col("rare") & ~F.col("given").isin(sorted(_GIVEN)))
    slips = near.filter(of("g") & one_edit & (F.substring("a", 1, 1) == F.substring("b", 1, 1)))
    either = slips.select("domain", "a", "b", F.explode(F.array("a", "b")).alias("given")).join(common, "given").select("domain", "a", "b").distinct()
    whole = lambda given: _tag(F.lit("p"), F.substring(given, 1, 1), F.substring_index("domain", "\u0001", -1), F.lit("g"), given)
    groups = connected_components(links.unionByName(either.select(whole("a").alias("a"), whole("b").alias("b"))))
    entity = lambda df: df.join(groups, "node", "left").withColumn("entity", F.coalesce("component", "node")).drop("component")

    people = cut(entity(people))
    full, short = people.filter("length(given) > 1"), people.filter("length(given) <= 1")
    # what persons the initials of a surname can stand for: counts and names only, never lists of persons
    both = near.filter(of("p"))
    asked = short.select("domain", "key", "middle").distinct()
    reach = asked.join(both.select("domain", F.col("a").alias("key"), F.col("b").alias("other")).unionByName(both.select("domain", F.col("b").alias("key"), F.col("a").alias("other"))), ["domain", "key"])
    reach = reach.select("domain", "key", "middle", "other").unionByName(asked.withColumn("other", F.col("key")))
    middles = full.groupBy("entity").agg(F.array_compact(F.collect_set(F.when(F.col("middle") != "", F.col("middle")))).alias("middles"))
    persons = full.select("domain", F.col("key").alias("other"), "entity").distinct().join(middles, "entity", "left")
    # a name that is surely a person's stands beside 'Bauer AG', which else is a firm
    sure = short.filter("firm = ''").select("domain", F.col("key").alias("other")).distinct().withColumns({"entity": F.lit(None).cast("string"), "middles": F.lit(None).cast("array<string>")})
    fits = reach.join(persons.unionByName(sure), ["domain", "other"]).select("domain", "key", "middle", "entity", "middles").distinct()
    known, bare = F.array_contains("middles", F.col("middle")), F.size("middles") == 0
    counted = fits.groupBy("domain", "key", "middle").agg(
        F.count("entity").alias("na"), F.min("entity").alias("pa"), F.count_if(bare).alias("nb"), F.min(F.when(bare, F.col("entity"))).alias("pb"), F.count_if(known).alias("nm"), F.min(F.when(known, F.col("entity"))).alias("pm")
    )
    joined = short.join(counted, ["domain", "key", "middle"], "left")
    none = F.col("middle") == ""
    person = F.when(F.col("nm") == 1, F.col("pm")).when(F.col("nm") > 1, F.lit(None)).when(none & (F.col("na") == 1), F.col("pa")).when(~none & (F.col("nb") == 1), F.col("pb"))
    initials = cut(joined.select("name", "firm", ((F.col("firm") == "") | F.col("na").isNotNull()).alias("as_person"), F.coalesce(person, "entity").alias("entity")))
    firms = initials.filter("not as_person").select("name", _tag(F.lit("org:"), "firm").alias("node"), F.lit("").alias("acronym"))

    orgs = cut(entity(orgs.select("name", _tag("domain", F.col("keys")[0]).alias("node"), "acronym").unionByName(firms)))
    owners = orgs.filter("acronym <> ''").groupBy("acronym").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))
    acronyms = parsed.filter("domain = 'acronym'").select("name", "acronym").join(owners, "acronym", "left")
    acronyms = acronyms.select("name", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(_tag(F.lit("acronym"), "acronym")).alias("entity"))
    return reduce(DataFrame.unionByName, [x.select("name", "entity") for x in (orgs, acronyms, full, initials.filter("as_person"))])


def same_entity_pairs(entities: DataFrame, piece: int = 256) -> DataFrame:
    """(name_a, name_b) with name_a < name_b by code point: all pairs of each entity. An entity of many names is cut into
    pieces of about ``piece`` names; every pair of pieces is its own join key, so that no task gets a whole hot entity."""
    entities = cut(entities.select("entity", "name"))
    sizes = entities.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("n"))
    rows = entities.join(sizes, "entity").withColumn("at", F.pmod(F.xxhash64("name"), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    a = rows.select("entity", F.col("at").alias("pa"), F.col("name").alias("name_a"), every.alias("pb"))
    b = rows.select("entity", F.col("at").alias("pb"), F.col("name").alias("name_b"), every.alias("pa"))
    return a.join(b, ["entity", "pa", "pb"]).filter("name_a < name_b").select("name_a", "name_b")
