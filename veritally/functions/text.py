"""Normalisers and tests of text. All are built-in expressions, but for exact Unicode folding, which Spark lacks."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that name a company's type, not the company.
COMPANY_TYPES = [
    "co", "company", "llc", "l", "c", "wll", "w", "ltd", "limited", "inc", "plc", "spc", "corp", "corporation", "fzco", "fze", "fzllc", "fz", "est",
    "establishment", "gmbh", "sa", "bv",
]

#: Spellings of units behind a number, in the order in which they are replaced.
UNITS = [
    (r"(\d)\s*(ml|millilit(?:er|re)s?)\b", "$1ml"),
    (r"(\d)\s*(g|gm|gms|grams?)\b", "$1g"),
    (r"(\d)\s*(kg|kilograms?)\b", "$1kg"),
    (r"(\d)\s*(l|lit(?:er|re)s?)\b", "$1l"),
    (r"(\d)\s*(oz|ounces?)\b", "$1oz"),
    (r"(\d)\s*(pcs?|pieces?)\b", "$1pc"),
]

#: Catalog headers that mean a role when no mapping was declared.
ITEM_HEADERS = ["item", "item id", "item code", "item number", "rms item id"]
UOM_HEADERS = ["uom", "unit", "unit of measure", "base unit", "order unit"]
SITE_HEADERS = ["location", "location code", "location name", "store", "store code", "store name"]
PO_HEADERS = ["po", "po no", "po number", "purchase order", "purchase order no", "purchase order number", "purchasing document"]
DESCRIPTION_HEADERS = ["name", "item name", "product name", "material name", "short text", "article name"]
SKU_HEADERS = [
    "sku", "item", "item code", "item id", "item number", "material", "material code", "material id", "material number", "product code",
    "product id", "article", "article code", "article number", "internal item",
]


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


@F.pandas_udf(StringType())
def fold_unicode(values: pd.Series) -> pd.Series:
    """Case-folded, decomposed (NFKD), without combining marks; null stays null."""

    def one(v: str | None) -> str | None:
        if v is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", v.casefold()) if not unicodedata.combining(c))

    return values.map(one, na_action="ignore")


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """By a rule over the letters and marks of Unicode up to U+FFFF: those that fold to one character, and to which; behind
    them those that fold to none. Hangul, whose syllables come apart, is left out."""
    single, removed = {}, []
    for code in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000)]:
        c = chr(code)
        lower = c.lower()
        if len(lower) != 1:
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if unicodedata.category(c)[0] not in "LMN" or folded == lower:
            continue
        if len(folded) == 1:
            single[lower] = folded
        elif not folded:
            removed.append(c)
    return "".join(single) + "".join(removed), "".join(single.values())


def fold(value: Column, exact: bool = False) -> Column:
    """Case and accents folded. The native form knows every letter that folds to one character, and ß; the exact one, a
    pandas function, also ligatures, fractions and Hangul."""
    if exact:
        return fold_unicode(value)
    return F.translate(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), *_folding())


def normalize_name(value: Column, exact: bool = False) -> Column:
    """Folded words of letters and digits with single blanks between."""
    return F.trim(F.regexp_replace(fold(value, exact), r"[^\p{L}\p{N}]+", " "))


def normalize_identifier(value: Column, exact: bool = False) -> Column:
    return F.replace(normalize_name(value, exact), F.lit(" "), F.lit(""))


def name_key(value: Column, exact: bool = False) -> Column:
    """Folded without blanks and punctuation, so that spaced-out banners compare equal."""
    return F.regexp_replace(fold(value, exact), r"[^\p{L}\p{N}]", "")


def strip_prefix(value: Column, prefix: str = "ULT_") -> Column:
    """Remove one prefix, in either case, and nothing else."""
    own = F.trim(value)
    return F.when(F.upper(F.substring(own, 1, len(prefix))) == prefix, F.substr(own, F.lit(len(prefix) + 1))).otherwise(own)


def normalize_barcode(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"[\s\-./]", "")


def normalize_description(value: Column, remove: list[Column] | None = None) -> Column:
    own = fold(value)
    for identifier in remove or []:
        own = F.when(F.coalesce(identifier, F.lit("")) != "", F.replace(own, fold(identifier), F.lit(" "))).otherwise(own)
    for pattern, unit in UNITS:
        own = F.regexp_replace(own, pattern, unit)
    return F.trim(F.regexp_replace(own, r"[^\p{L}\p{N}_#]+", " "))


def squash(value: Column) -> Column:
    """Lower case without any white space, for equality of evidence."""
    return F.lower(F.regexp_replace(value, r"\s+", ""))


def alnum_fold(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[^0-9a-z]", "")


def text_key(value: Column) -> Column:
    return F.nullif(F.regexp_replace(value, r"\s+", ""), F.lit(""))


def tokens(value: Column) -> Column:
    """Words of ASCII letters and digits in the folded text."""
    return F.regexp_extract_all(fold(value), F.lit("([a-z0-9]+)"), 1)


def entity_tokens(value: Column) -> Column:
    return F.filter(tokens(value), lambda t: ~t.isin(COMPANY_TYPES))


def has_words(own: Column, words: Column) -> Column:
    """True if the words, at least one, stand in the tokens one after the other; neither holds blanks."""

    def told(tokens: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))

    return (F.size(words) > 0) & F.contains(told(own), told(words))


def supplier_key(name: Column) -> Column:
    own = F.upper(F.regexp_replace(name, r"\s+", ""))
    return F.when(F.length(own) >= 6, F.substring(own, 1, 6))


def entity_suffix(name: Column) -> Column:
    return F.substr(F.upper(F.regexp_replace(name, r"\s+", "")), F.lit(7))


def entity_hint(name: Column) -> Column:
    """(suffix, entity, currency_hint) of what stands behind the six-character key."""
    suffix = entity_suffix(name)
    shaped = suffix.rlike(r"^[A-Z]{2}\d([A-Z]{3})?$")
    return F.struct(
        F.nullif(suffix, F.lit("")).alias("suffix"),
        F.when(shaped, F.substring(suffix, 1, 3)).alias("entity"),
        F.when(shaped, F.nullif(F.substr(suffix, F.lit(4)), F.lit(""))).alias("currency_hint"),
    )


def is_safe_text(value: Column, longest: int = 500) -> Column:
    """No control characters, not too long, and no first character that a spreadsheet takes for a formula."""
    return ~value.rlike(r"[\x00-\x1F\x7F]") & ~F.ltrim(value).rlike(r"^[=+\-@]") & (F.length(value) <= longest)


#: Labels before a party's name, and what follows it.
PARTY_LABELS = r"(?i)^(?:(?:bill\s+to|buyer)\b\s*:?[ \t|,-]*)+"
PARTY_END = r"(?i)\b(?:ship\s+to|deliver\s+to|p\.?\s*o\.?\s*box|address|tel(?:ephone)?|trn)\b"


def clean_party_name(value: Column) -> Column:
    """A party's name without labels before it and an address behind it; null if no fit name of 2 to 160 characters is left."""
    plain = F.btrim(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(" :|-"))
    own = F.btrim(F.split(F.regexp_replace(plain, PARTY_LABELS, ""), PARTY_END, 2)[0], F.lit(" :|-,"))
    fit = F.length(own).between(2, 160) & own.rlike(r"\p{L}") & ~own.rlike(r"^[=+\-@]") & ~own.rlike(r"[\x00-\x1F]") & ~F.lower(own).isin("ship to", "deliver to")
    return F.when(fit, own)


def slug(value: Column, longest: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, longest)


def safe_file_name(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_")


def part_file_name(name: Column, index: Column, count: Column, number: Column) -> Column:
    return F.concat(
        F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(" ["), index.cast("string"), F.lit(" of "), count.cast("string"),
        F.coalesce(F.concat(F.lit(" "), number), F.lit("")), F.lit("]"), F.regexp_extract(name, r"(\.[^.]*)$", 1),
    )


def description_facts(value: Column) -> Column:
    """(description, sku, origin, hs_code) of a description with labelled metadata behind it."""
    parts = F.transform(F.split(value, r"(?i)[\s,;|]*(?=\b(?:sku|coo|hs code)\s*:)"), lambda p: F.trim(p))

    def fact(label: str) -> Column:
        own = F.filter(parts, lambda p: p.rlike(rf"(?i)^{label}\s*:"))
        return F.nullif(F.trim(F.regexp_extract(F.get(own, F.lit(0)), r"^[^:]*:\s*(.*)$", 1)), F.lit(""))

    return F.struct(F.nullif(F.get(parts, F.lit(0)), F.lit("")).alias("description"), fact("sku").alias("sku"), fact("coo").alias("origin"), fact("hs code").alias("hs_code"))


def header_roles(header: Column) -> Column:
    """Roles of a catalog column by its header alone; for kinds without a declared mapping."""
    own = normalize_name(header)
    words = F.split(own, " ")

    def has(*names: str) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))

    def role(name: str, test: Column) -> Column:
        return F.when(test, F.lit(name))

    guessed = F.array_compact(
        F.array(
            role("gtin", has("gtin", "upc", "ean", "barcode")),
            role("uom", own.isin(UOM_HEADERS)),
            role("pack", has("pack") & ~has("description", "name")),
            role("supplier", has("supplier", "vendor")),
            role("site", has("site", "plant", "warehouse", "branch") | own.isin(SITE_HEADERS)),
            role("po", own.isin(PO_HEADERS)),
            role("description", has("description") | own.isin(DESCRIPTION_HEADERS)),
            role("sku", own.isin(SKU_HEADERS)),
        )
    )
    return F.when(own.isin(ITEM_HEADERS), F.array(F.lit("internal_item"))).otherwise(guessed)


def evidence_kind(source: Column, quote: Column, has_box: Column) -> Column:
    """Where a value comes from, by the first test that holds."""
    return (
        F.when(source == "owner", "owner entry").when(has_box & quote.isNotNull(), "printed at").when(quote.isNotNull(), "printed")
        .when(source.rlike(r"^[^!]+!\d+$"), "source row").when(source.isNotNull(), "rule").otherwise("none")
    )
