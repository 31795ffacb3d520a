"""Exact decimals, check digits and barcode shapes. A value that cannot be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO minor units where they aren't two, and the approval policy's own table.
CURRENCY_DECIMALS = {"KWD": 3, "BHD": 3, "OMR": 3, "JOD": 3, "IQD": 3, "TND": 3, "LYD": 3}
POLICY_DECIMALS = {"AED": 2, "KWD": 3, "USD": 2, "EUR": 2}
#: Tolerances of a value by currency, compared at two decimals.
VALUE_TOLERANCE = {"KWD": 1, "AED": 2}
GTIN_LENGTHS = (8, 12, 13, 14)
#: Characters that a scan confuses.
SWAPS = {"I": "1", "1": "I", "O": "0", "0": "O"}
MOST_SWAPS = 8


def to_decimal(value: Column, kind: str = "decimal(38,6)") -> Column:
    return F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast(kind)


def clue(value: Column) -> Column:
    """A number in strict thousands grammar, of at most 80 characters and 1e18."""
    own = F.trim(value)
    number = F.replace(own, F.lit(","), F.lit("")).try_cast("decimal(38,6)")
    strict = own.rlike(r"^[+-]?(?:(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?|\.\d+)$") & (F.length(own) <= 80)
    return F.when(strict & (F.abs(number) <= F.lit(10**18).cast("decimal(20,0)")), number)


def printed_decimal(value: Column) -> Column:
    """A printed amount: currency codes dropped, brackets for a minus, blanks in thousands, ``1.234.56`` repaired."""
    own = F.trim(F.regexp_replace(F.upper(value), r"(?:AED|KWD|USD|EUR|GBP|SAR|QAR|OMR|BHD)|[$€£]", ""))
    minus = own.rlike(r"^\(.*\)$")
    own = F.regexp_replace(F.regexp_replace(own, r"[(),\s]", ""), r"\.(?=\d{3}\.)", "")
    number = F.when(own.rlike(r"^[+-]?\d+(?:\.\d+)?$"), own.try_cast("decimal(38,6)"))
    return F.when(minus, -number).otherwise(number)


def plain_decimal(value: Column) -> Column:
    own = F.replace(F.trim(value), F.lit(","), F.lit(""))
    return F.when(own.rlike(r"^\d{1,24}(?:\.\d{1,6})?$"), own.try_cast("decimal(38,6)"))


def entered_decimal(value: Column) -> Column:
    """A manual entry: no sign, no leading zeros, at most four places."""
    return F.when(value.rlike(r"^(0|[1-9]\d*)(\.\d{1,4})?$"), value.try_cast("decimal(24,4)"))


def decimals(currency: Column, table: dict[str, int] | None = None) -> Column:
    own = F.upper(F.trim(currency))
    out: Column | None = None
    for code, places in (CURRENCY_DECIMALS if table is None else table).items():
        out = F.when(own == code, places) if out is None else out.when(own == code, places)
    return out.otherwise(2) if out is not None else F.lit(2)


def round_to(value: Column, places: Column, most: int = 4) -> Column:
    """Half-up rounding at a scale that varies by row; ``round`` takes only a constant one."""
    kind = f"decimal(38,{most})"
    out = F.round(value, most).cast(kind)
    for n in range(most):
        out = F.when(places == n, F.round(value, n).cast(kind)).otherwise(out)
    return out


def places(text: Column) -> Column:
    """Decimal places of a value as read."""
    return F.when(F.instr(text, ".") > 0, F.length(F.substring_index(text, ".", -1))).when(text.isNotNull(), 0)


def _weighted(digits: Column) -> Column:
    """Sum over the digits from the right, alternating weights three and one."""
    reversed_digits = F.reverse(digits)
    places = F.sequence(F.lit(1), F.greatest(F.length(reversed_digits), F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda total, i: total + F.coalesce(F.substr(reversed_digits, i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 3).otherwise(1))


def _checked(digits: Column) -> Column:
    return (10 - _weighted(F.substr(digits, F.lit(1), F.length(digits) - 1)) % 10) % 10 == F.right(digits, F.lit(1)).try_cast("int")


def gtin_valid(digits: Column) -> Column:
    """GS1 check digit of a code of 8, 12, 13 or 14 digits."""
    return F.coalesce(digits.rlike(r"^\d+$") & F.length(digits).isin(*GTIN_LENGTHS) & _checked(digits), F.lit(False))


def upc_valid(digits: Column) -> Column:
    return F.coalesce(digits.rlike(r"^\d{12}$") & _checked(digits), F.lit(False))


def barcode_digits(value: Column) -> Column:
    """Digits of a printed code: what stands before the first one is dropped, and separators; gaps give null."""
    own = F.trim(F.regexp_replace(F.regexp_replace(F.trim(value), r"^[^0-9]*", ""), r"(?<=\d)[\s-](?=\d)", ""))
    return F.when(own.rlike(r"^\d+$"), own)


def classify_barcode(value: Column) -> Column:
    """(gtin, unchecked, reason) of a printed barcode."""
    digits = barcode_digits(value)
    sized = digits.isNotNull() & F.length(digits).between(min(GTIN_LENGTHS), max(GTIN_LENGTHS))
    valid = sized & gtin_valid(digits)
    return F.struct(
        F.when(valid, digits).alias("gtin"),
        F.when(sized & ~valid, digits).alias("unchecked"),
        F.when(F.coalesce(value, F.lit("")) == "", None).when(~sized, "unreadable").when(~valid, "misprint").alias("reason"),
    )


def similarity(left: Column, right: Column) -> Column:
    size = F.greatest(F.abs(left), F.abs(right), F.lit("0.000001").cast("decimal(7,6)"))
    return F.when(left.isNotNull() & right.isNotNull(), F.greatest(F.lit(0.0), 1 - (F.abs(left - right) / size).cast("double")))


def ocr_variants(value: Column) -> Column:
    """All readings with some confusable characters swapped, never the value itself; none beyond eight of them."""
    n = F.length(value)
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(value, i, F.lit(1)).isin(*SWAPS))
    count = F.size(places)

    def swapped(mask: Column) -> Column:
        def letter(i: Column) -> Column:
            c = F.substr(value, i, F.lit(1))
            bit = F.array_position(places, i) - 1
            turn = F.when(bit < 0, F.lit(0)).otherwise(F.floor(mask / F.pow(F.lit(2), bit)) % 2)
            return F.when(turn == 1, F.translate(c, "I1O0", "1I0O")).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), n), letter), "")

    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), count) - 1).cast("int"))
    return F.when(count.between(1, MOST_SWAPS), F.transform(masks, swapped)).otherwise(F.array().cast("array<string>"))


def variant_upc(code: Column) -> Column:
    """The UPC inside a supplier's variant code ``AA-<12>``, ``AA-<12>-99[9]`` or ``<12>-AA``, if its check digit holds."""
    core = F.coalesce(F.nullif(F.regexp_extract(code, r"^[A-Z]{2}-(\d{12})(?:-\d{2,3})?$", 1), F.lit("")), F.nullif(F.regexp_extract(code, r"^(\d{12})-[A-Z]{2}$", 1), F.lit("")))
    return F.when(upc_valid(core), core)


def gtin_in_text(value: Column) -> Column:
    """The only distinct run of 8, 12, 13 or 14 digits in a text, else the text itself."""
    runs = F.array_distinct(F.filter(F.regexp_extract_all(value, F.lit(r"(\d+)"), 1), lambda x: F.length(x).isin(*GTIN_LENGTHS)))
    return F.when(F.size(runs) == 1, runs[0]).otherwise(value)


def split_barcode(description: Column) -> Column:
    """(description, barcode): a trailing code with a valid check digit is split off."""
    code = F.regexp_extract(description, r"(?:^|\s)(\d{8}|\d{12,14})\s*$", 1)
    valid = gtin_valid(code)
    return F.struct(F.when(valid, F.rtrim(F.regexp_replace(description, r"\s*\d+\s*$", ""))).otherwise(description).alias("description"), F.when(valid, code).alias("barcode"))


def value_tolerance(currency: Column) -> Column:
    out = F.lit(0)
    for code, amount in VALUE_TOLERANCE.items():
        out = F.when(F.upper(currency) == code, amount).otherwise(out)
    return out.cast("decimal(4,2)")


def amount_forms(value: Column) -> Column:
    """How a decimal may be printed: as it is and with two decimals, both with thousands commas or without; no bare zero."""
    own = value.cast("string")
    whole = F.regexp_replace(own, r"(?<=\d)(?=(?:\d{3})+(?:\.|$))(?<!\.\d{1,9})", ",")
    two = F.format_number(value, 2)
    found = F.array_distinct(F.filter(F.array(own, whole, F.replace(two, F.lit(","), F.lit("")), two), lambda f: ~f.isin("0", "0.00")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("0.00")))


def dropped_point(quantity: Column, price: Column, amounts: Column) -> Column:
    """The power of ten by which a price was read too large, if the amount it then gives is printed; else null."""

    def printed_at(k: int) -> Column:
        return F.exists(amounts, lambda a: a == (quantity * price / 10**k).cast("decimal(18,4)"))

    return F.when(printed_at(0), None).when(printed_at(1), 1).when(printed_at(2), 2).when(printed_at(3), 3)
