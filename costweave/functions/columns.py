"""Column builders: keys, texts, numbers, dates and ratios. All stay in generated JVM code."""

from __future__ import annotations

import unicodedata
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Approved categories, scope keywords, description sets, stop words.
DIRECT_ALIASES = {
    "COS": "COS",
    "INVENTORY": "Inventory",
    "OPERATING SUPPLIES": "Operating Supplies",
    "PRODUCTION SUPPLIES": "Production Supplies",
    "PRODUCTION AIDS": "Production Aids",
    "SMALL TOOLS": "Small Tooling",
    "SMALL TOOLING": "Small Tooling",
}
EXCLUDE_WORDS = ("labor", "shipping", "freight", "consulting", "repairs & maint", "repairs and maint")
REVIEW_WORDS = ("unsure", "needs review", "other", "misc")
PHYSICAL_DESCRIPTIONS = ("INVENTORY", "PRODUCTION SUPPLIES", "OPERATING SUPPLIES", "PRODUCTION AIDS", "SMALL TOOLS")
NULL_WORDS = ("", "NAN", "NONE", "NULL")
STOP_WORDS = ("A", "AN", "AND", "FOR", "OF", "THE", "TO", "WITH", "ASSY", "ASSEMBLY")
BASIS_TOLERANCE = 0.03


#: Planes that hold characters with a compatibility form, a decomposition or a combining class.
_CODES = [c for c in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)) if not 0xAC00 <= c < 0xD7A4]
_HANGUL = 0xAC00


def _unicode_tables() -> tuple[dict[str, str], dict[str, str], dict[str, str], dict[str, int], dict[str, str]]:
    """Characters with another compatibility form (NFKC) of one and of more characters, with a full decomposition (NFKD), with a combining class, and the pairs that compose."""
    single, longer, apart, classes, pairs = {}, {}, {}, {}, {}
    for c in map(chr, _CODES):
        form, parts = unicodedata.normalize("NFKC", c), unicodedata.normalize("NFKD", c)
        if form != c:
            (single if len(form) == 1 else longer)[c] = form
        if parts != c:
            apart[c] = parts
        if kind := unicodedata.combining(c):
            classes[c] = kind
        halves = unicodedata.decomposition(c).split()
        if len(halves) == 2 and "<" not in halves[0] and form == c:
            pairs["".join(chr(int(h, 16)) for h in halves)] = c
    return single, longer, apart, classes, pairs


_SINGLE, _LONGER, _APART, _CLASSES, _PAIRS = _unicode_tables()


def _joining() -> str:
    """Pattern of a character that may change with the ones before it: a mark, the second of a pair, a vowel or final of Hangul."""
    second = {p[1] for p in _PAIRS} | set(_CLASSES) | set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))
    ranges: list[list[int]] = []
    for c in _CODES:
        if _APART.get(chr(c), chr(c))[0] in second:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(rf"\x{{{x:X}}}-\x{{{y:X}}}" for x, y in ranges) + "]"


_JOINING = _joining()


def _lookup(table: dict[str, str]) -> Column:
    return F.map_from_arrays(F.split(F.lit("\x01".join(table)), "\x01"), F.split(F.lit("\x01".join(table.values())), "\x01"))


def _character(code: Column) -> Column:
    """The character of a code point of the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def _composed(text: Column) -> Column:
    """Full NFKC: characters taken apart, marks brought into the order of their combining classes, pairs composed from the left."""
    apart, pairs = _lookup(_APART), _lookup(_PAIRS)
    classes = _lookup({c: str(k) for c, k in _CLASSES.items()})

    def parts(c: Column) -> Column:
        at = F.ascii(c) - _HANGUL
        final = F.when(at % 28 > 0, _character(0x11A7 + at % 28)).otherwise("")
        syllable = F.concat(_character(0x1100 + F.floor(at / 588)), _character(0x1161 + F.floor(at % 588 / 28)), final)
        return F.when(c.between("\uac00", "\ud7a3") & (F.length(c) == 1), syllable).otherwise(F.coalesce(F.try_element_at(apart, c), c))

    def joined(a: Column, b: Column) -> Column:
        x, y = F.ascii(a), F.ascii(b)
        leading = x.between(0x1100, 0x1112) & y.between(0x1161, 0x1175)
        trailing = x.between(0xAC00, 0xD7A3) & ((x - _HANGUL) % 28 == 0) & y.between(0x11A8, 0x11C2)
        return F.when(leading, _character(_HANGUL + (x - 0x1100) * 588 + (y - 0x1161) * 28)).when(trailing, _character(x + y - 0x11A7)).otherwise(F.try_element_at(pairs, F.concat(a, b)))

    text_type = "struct<block:int,rows:array<struct<block:int,kind:int,place:int,c:string>>>"
    chars = F.split(F.array_join(F.transform(F.split(text, ""), parts), ""), "")
    marked = F.transform(chars, lambda c, i: F.struct(F.lit(0).alias("block"), F.coalesce(F.try_element_at(classes, c).cast("int"), F.lit(0)).alias("kind"), i.alias("place"), c.alias("c")))

    def numbered(acc: Column, r: Column) -> Column:  # a new block begins at each character that is no mark
        block = acc["block"] + F.when(r["kind"] == 0, 1).otherwise(0)
        row = F.struct(block.alias("block"), r["kind"].alias("kind"), r["place"].alias("place"), r["c"].alias("c"))
        return F.struct(block.alias("block"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    empty = F.from_json(F.lit('{"block":0,"rows":[]}'), text_type)
    ordered = F.array_sort(F.aggregate(marked, empty, numbered, lambda acc: acc["rows"]))

    def step(acc: Column, r: Column) -> Column:
        free = (acc["tail"] == "") | (acc["last"] < r["kind"])  # nothing between blocks the two
        one = F.when(free & (acc["head"] != ""), joined(acc["head"], r["c"]))
        starts = r["kind"] == 0
        return F.struct(
            F.when(one.isNull() & starts, F.concat(acc["done"], acc["head"], acc["tail"])).otherwise(acc["done"]).alias("done"),
            F.coalesce(one, F.when(starts, r["c"]).otherwise(acc["head"])).alias("head"),
            F.when(one.isNotNull(), acc["tail"]).when(starts, "").otherwise(F.concat(acc["tail"], r["c"])).alias("tail"),
            F.when(one.isNotNull(), acc["last"]).otherwise(r["kind"]).alias("last"),
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("head"), F.lit("").alias("tail"), F.lit(0).alias("last"))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["done"], acc["head"], acc["tail"]))


def compatible(text: Column) -> Column:
    """Text in Unicode's compatibility form (NFKC): full-width digits, ligatures and no-break spaces as plain characters, letters with their accents.

    ASCII texts are left alone; others go character by character, and only those that hold a mark (or a part of a Hangul syllable) are taken apart and composed.
    """
    plain = F.translate(text, "".join(_SINGLE), "".join(_SINGLE.values()))
    table = _lookup(_LONGER)
    longer = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(~text.rlike(r"[^\x00-\x7F]"), text).when(text.rlike(_JOINING), _composed(text)).otherwise(longer)


def squeezed(text: Column) -> Column:
    """Upper case, trimmed, runs of white space as one space."""
    return F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))


def part_key(part_number: Column, kind: Column) -> Column:
    """Part key; integral numbers lose their fraction, punctuation stays, blanks and null words are null."""
    number = F.regexp_replace(F.regexp_replace(part_number, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    key = squeezed(F.when(kind.isin("int", "float") & part_number.contains("."), number).otherwise(compatible(part_number)))
    return F.when(~key.isin(*NULL_WORDS), key)


def part_key_status(part_number: Column, key: Column) -> Column:
    return F.when(part_number.isNull(), "missing").when(key.isNull(), "empty_after_norm").otherwise("ok")


def description_norm(text: Column) -> Column:
    key = squeezed(compatible(text))
    return F.when(~key.isin(*NULL_WORDS), key)


def words_only(text: Column) -> Column:
    """Upper-case letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Distinct words of two characters or more that are no stop words."""
    return F.array_distinct(F.filter(F.split(words_only(text), " "), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def family_prefix(key: Column) -> Column:
    """Leading token of a key where it starts with two letters; 12 characters at most, else empty."""
    head = F.element_at(F.split(F.upper(F.trim(key)), r"[\s/_.\-]+", 2), 1)
    return F.substring(F.regexp_extract(head, "^([A-Z]{2,}[A-Z0-9]*)", 1), 1, 12)


def direct_category(description: Column) -> Column:
    """One of the six approved buckets, or null."""
    name = squeezed(F.coalesce(description, F.lit("")))
    aliases = F.create_map(*(F.lit(x) for pair in DIRECT_ALIASES.items() for x in pair))
    return F.when(name.startswith("COST OF SALES"), "COS").otherwise(F.try_element_at(aliases, name))


def scope_decision(bucket: Column, description: Column) -> Column:
    """struct(decision, category, reason): approved, excluded by keyword, or for review."""
    text = F.lower(F.concat(F.coalesce(bucket, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    approved = direct_category(description)
    label = F.when(F.trim(F.coalesce(description, F.lit(""))) == "", "Uncategorized").otherwise(F.initcap(F.lower(squeezed(description))))

    def row(decision: str, category: Column, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), category.alias("category"), F.lit(reason).alias("reason"))

    out = F.when(approved.isNotNull(), row("Include", approved, "approved direct-cost category"))
    for word in EXCLUDE_WORDS:
        out = out.when(text.contains(word), row("Exclude", label, f"exclude keyword: {word}"))
    for word in REVIEW_WORDS:
        out = out.when(text.contains(word), row("Needs Review", label, f"ambiguous keyword: {word}"))
    return out.otherwise(row("Needs Review", label, "no keyword"))


def number(text: Column) -> Column:
    """Double of a text with thousands commas or dollar signs; null where there is none."""
    return F.regexp_replace(F.trim(text), "[,$]", "").try_cast("double")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def close(a: Column, b: Column, relative: float = 1e-4, absolute: float = 0.01) -> Column:
    return F.coalesce(F.abs(a - b) <= absolute + relative * F.abs(b), F.lit(False))


def basis_factor(r: Column) -> Column:
    """The power of ten from 0.001 to 1000 nearest to a ratio, where it is within 3 %."""
    nearest = F.pow(F.lit(10.0), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.round(F.log10(r)))))
    return F.when((r > 0) & (F.abs(r / nearest - 1) <= BASIS_TOLERANCE), nearest)


def positive(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0)) > 0


def clip(x: Column, low, high) -> Column:
    """``x`` between the bounds; a null ``x`` stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def fiscal_year(d: Column, start_month: int = 10) -> Column:
    return (F.year(d) + F.when(F.month(d) >= start_month, 1).otherwise(0)).cast("int")


def fiscal_label(d: Column, start_month: int = 10) -> Column:
    return F.concat(F.lit("FY"), fiscal_year(d, start_month).cast("string"))


def period_start(d: Column, freq: str, start_month: int = 10) -> Column:
    """First day of the month (M), calendar quarter (Q) or fiscal year (FY)."""
    if freq == "M":
        return F.trunc(d, "month")
    if freq == "Q":
        return F.trunc(d, "quarter")
    return F.make_date(fiscal_year(d, start_month) - (1 if start_month > 1 else 0), F.lit(start_month), F.lit(1))


def period_end(d: Column, freq: str, start_month: int = 10) -> Column:
    return F.date_sub(F.add_months(period_start(d, freq, start_month), {"M": 1, "Q": 3, "FY": 12}[freq]), 1)


def period_ordinal(d: Column, freq: str, start_month: int = 10) -> Column:
    """Consecutive periods have consecutive numbers."""
    if freq == "M":
        return F.year(d) * 12 + F.month(d)
    if freq == "Q":
        return F.year(d) * 4 + F.quarter(d)
    return fiscal_year(d, start_month)


def last_complete_month_end(d: Column) -> Column:
    return F.when(d == F.last_day(d), d).otherwise(F.last_day(F.add_months(d, -1)))


def within(d: Column, start: date, end: date) -> Column:
    return F.coalesce(d.between(F.lit(start), F.lit(end)), F.lit(False))
