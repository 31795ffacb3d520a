"""Facts of printed text and of what readers made of it: headings, labels, dates, codes, and the reasons that hold a read back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse
from .numbers import classify_barcode, plain_decimal
from .text import entity_tokens, has_words, normalize_name

#: Headings of table columns that mean a role, packed without blanks; the first that equals decides.
EXACT_ROLES = {
    "serial": ["sn", "sno", "sr", "srno", "serialno", "serialnumber"], "part_code": ["barcodepart", "barcodepartnumber"], "gtin": ["barcode", "gtin", "ean", "upc"],
    "description": ["description", "productdescription", "itemdescription", "productname", "itemname", "servicedescription", "particulars", "name"], "size": ["size"],
    "sku": ["productreference", "itemcode", "itemnumber", "sku", "article"], "qty": ["qty", "quantity", "qtyinpce", "qtypce"], "uom": ["uom", "unitofmeasure", "measureunit"],
    "price": ["price", "sellingprice", "unitprice", "priceperunit"], "net_amount": ["amount", "taxablevalue", "netamount", "lineamount", "totalprice", "subtotal"], "tax_rate": ["taxrate", "vatrate", "taxpercent"],
    "tax_amount": ["taxamount", "vatamount", "taxamt", "vatamt"], "gross_amount": ["grossamount", "amountincludingtax", "total"], "other_amount": ["otheramount"],
}
#: What a packed heading contains that means a role, in the order of the tests.
ROLE_PARTS = [
    ("serial", ["serialnumber", "serialno", "srno", "sr"]), ("gtin", ["barcode", "gtin", "ean", "upc"]),
    ("description", ["productdescription", "itemdescription", "description", "productname", "itemname", "servicedescription", "particulars", "name"]),
    ("sku", ["productreference", "itemcode", "itemnumber", "sku", "article"]), ("qty", ["quantity", "qtyinpce", "qtypce", "qty"]), ("uom", ["unitofmeasure", "uom", "measureunit"]),
    ("tax_amount", ["taxamount", "vatamount", "taxamt", "vatamt"]), ("tax_rate", ["taxrate", "vatrate", "taxpercent"]),
    ("net_amount", ["taxablevalue", "netamount", "lineamount", "totalprice", "subtotal"]), ("gross_amount", ["grossamount", "amountincludingtax"]), ("price", ["sellingprice", "unitprice", "priceperunit", "price"]),
]
CURRENCIES = "AED|USD|EUR|GBP|KWD|SAR|QAR|BHD|OMR"
#: Labels of header tables and the field of each.
HEADER_LABELS = {
    "tax invoice no": "number", "tax invoice number": "number", "invoice no": "number", "invoice number": "number", "tax invoice date": "date", "invoice date": "date", "document date": "date",
    "customer po no": "po", "customer po number": "po", "purchase order no": "po", "purchase order number": "po", "po no": "po", "po number": "po", "currency": "currency",
}
#: Formats under which a printed date may be the one read, either order of day and month.
CONFIRMING = [
    "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yy", "dd-MM-yy", "dd-MMM-yyyy", "dd MMM yyyy", "dd/MMM/yyyy", "d MMMM yyyy",
    "d-MMMM-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy",
]
#: Titles of documents, and a PO label.
INVOICE_TITLE = r"(?im)(?:\b(?:tax|commercial|sales|debit)\s+invoice\b|\bcredit\s*invoice\b|^\s*invoice\s*$)"
PACKING_TITLE = r"(?i)\bpacking\s+(?:list|slip)\b"
ORDER_TITLE = r"(?im)^\s*purchase\s+order(?:\s+no\b[^\n]*)?\s*$"
PO_LABEL = r"(?i)\b(?:customer\s+)?(?:p\.?\s*o\.?\s*(?:no\b\.?|number\b|#)|lpo\b|purchase\s+order\s*(?:no\b\.?|number\b|#|:))"
PO_BOX = r"(?i)\bp\.?\s*o\.?\s*box\b"
#: Image types, and characters under which a PDF has no text of its own.
IMAGES, NATIVE_CHARS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp"), 40


def packed(header: Column) -> Column:
    return F.replace(normalize_name(header), F.lit(" "), F.lit(""))


def exact_role(header: Column, own: Column | None = None) -> Column:
    """The role of a heading that is one of the known ones; a printed VAT rate is a tax amount, an amount in a currency another one.

    ``own`` is the packed heading where a caller has it already.
    """
    own = packed(header) if own is None else own
    out = F.when(F.rlike(header, F.lit(r"(?i)^\s*(?:vat|tax)\s*\d+(?:\.\d+)?\s*%\s*$")), "tax_amount").when(F.rlike(header, F.lit(rf"(?i)^\s*amount\s+(?:{CURRENCIES})\s*$")), "other_amount")
    for role, names in EXACT_ROLES.items():
        out = out.when(own.isin(names), role)
    return out


def role(header: Column) -> Column:
    """The role of a heading: a known one, else by the first part that it contains."""
    own = packed(header)
    out = F.when(exact_role(header).isNotNull(), exact_role(header)).when(own.isin("sn", "sno"), "serial").when(own.isin("barcodepart", "barcodepartnumber", "partcode"), "part_code")
    for name, parts in ROLE_PARTS:
        out = out.when(F.rlike(own, F.lit("|".join(parts))), name)
    return out


def header_label(text: Column) -> Column:
    """The header label that a text is, or the only one of its length, ten or more, from which under a tenth of the letters differ."""
    own = normalize_name(text)
    labels = F.array(*[F.lit(x) for x in HEADER_LABELS])

    def apart(label: Column) -> Column:
        return F.aggregate(F.zip_with(F.split(own, ""), F.split(label, ""), lambda a, b: (~a.eqNullSafe(b)).cast("int")), F.lit(0), lambda s, x: s + x)

    near = F.filter(labels, lambda x: (F.length(x) == F.length(own)) & (apart(x) * 10 <= F.length(own)))
    return F.when(own.isin(list(HEADER_LABELS)), own).when((F.length(own) >= 10) & (F.size(near) == 1), near[0])


def header_field(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in HEADER_LABELS.items() for x in pair]), label)


def header_value(field: Column, value: Column, parsed_date: Column) -> Column:
    """A value fit for its field, else null."""
    own = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    fit = F.length(own).between(1, 80)
    return F.when(fit & (field == "date"), parsed_date).when(fit & (field == "currency") & own.rlike(r"^[A-Za-z]{3}$"), F.upper(own)).when(fit & field.isin("number", "po") & own.rlike(r"^[A-Za-z0-9][A-Za-z0-9./_-]{0,79}$"), own)


def confirms(printed: Column, iso: Column) -> Column:
    """True if the printed text can be the date, in some order of day and month."""
    own = F.regexp_replace(F.regexp_replace(F.trim(printed), r"\s*([-/.])\s*", "$1"), r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    found = F.array(*[F.try_to_timestamp(own, F.lit(f)).cast("date") for f in CONFIRMING])
    return F.coalesce(F.array_contains(found, iso.try_cast("date")), F.lit(False))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def only(values: Column) -> Column:
    """The first spelling of the only distinct value of an array, cases apart."""
    return F.when(F.size(F.array_distinct(F.transform(values, lambda v: F.lower(v)))) == 1, values[0])


def labelled_date(text: Column) -> Column:
    """The only date behind a label, by the first kind of label that has any: document, invoice, date alone, date anywhere."""
    kinds = [r"(?i)\bdocument\s+date\s*:?\s*([0-9A-Z./ -]{6,24})", r"(?i)\binvoice\s+date\s*:?\s*([0-9A-Z./ -]{6,24})", r"(?i)^\s*date\s*:?\s*([0-9A-Z./ -]{6,24})\s*$", r"(?i)(?<!report\srun\s)(?<!run\s)\bdate\s*:?\s*([0-9A-Z./ -]{6,24})"]
    out = F.lit(None).cast("date")

    def behind(label: str) -> Column:
        return F.transform(lines_of(text), lambda x: parse(F.nullif(F.trim(F.regexp_extract(x, label, 1)), F.lit(""))))

    for kind in reversed(kinds):
        dates = F.array_distinct(F.filter(behind(kind), lambda d: d.isNotNull()))
        out = F.when(F.size(dates) == 1, dates[0]).when(F.size(dates) == 0, out)
    return out


def first_matches(text: Column, patterns: list[str]) -> Column:
    """Of each line the value behind the first pattern that it has."""

    def of(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for p in reversed(patterns):
            out = F.when(F.rlike(line, F.lit(p)), F.regexp_extract(line, p, 1)).otherwise(out)
        return out

    return F.filter(F.transform(lines_of(text), of), lambda v: v.isNotNull())


def printed_currency(text: Column) -> Column:
    patterns = [r"(?i)\bcurrency\s*:\s*([A-Z]{3})\b", r"(?i)\btotal\s+in\s+([A-Z]{3})\b", r"(?i)^\s*total\s+([A-Z]{3})\s+[0-9][0-9,.]*\s*$", rf"(?i)\bamount\s+({CURRENCIES})\b"]
    return only(F.transform(first_matches(text, patterns), lambda v: F.upper(v)))


def printed_money(text: Column, patterns: list[str]) -> Column:
    """The only distinct amount behind the patterns."""
    found = F.array_distinct(F.filter(F.transform(first_matches(text, patterns), plain_decimal), lambda v: v.isNotNull()))
    return F.when(F.size(found) == 1, found[0])


def printed_identifier(text: Column, patterns: list[str]) -> Column:
    """The only identifier behind the patterns: safe characters, with a digit."""
    own = F.transform(first_matches(text, patterns), lambda v: F.regexp_replace(F.trim(v), r"[.,:;]+$", ""))
    return only(F.filter(own, lambda v: v.rlike(r"^[A-Za-z0-9][A-Za-z0-9./_-]{0,79}$") & v.rlike(r"\d")))


def is_packing_page(text: Column) -> Column:
    return text.rlike(PACKING_TITLE) & ~text.rlike(INVOICE_TITLE)


def is_purchase_order(text: Column) -> Column:
    """A purchase order's title that stands before any invoice title."""
    order, invoice = F.regexp_instr(text, F.lit(ORDER_TITLE)), F.regexp_instr(text, F.lit(INVOICE_TITLE))
    return (order > 0) & ((invoice == 0) | (order < invoice))


def po_label(text: Column) -> Column:
    """The first printed PO label on a line that is no box address, without its colon."""
    rows = F.filter(lines_of(text), lambda x: x.rlike(PO_LABEL) & ~x.rlike(PO_BOX))
    return F.regexp_replace(F.regexp_replace(F.regexp_substr(F.get(rows, F.lit(0)), F.lit(PO_LABEL)), r"\s+", " "), r":+$", "")


def is_scan(native_chars: Column, path: Column) -> Column:
    """An image, or a PDF with hardly any text of its own."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return suffix.isin(*IMAGES) | ((suffix == ".pdf") & F.coalesce(native_chars < NATIVE_CHARS, F.lit(False)))


def not_located(source: Column, reference: Column) -> Column:
    """An AI's value without a box on its page."""
    return (F.coalesce(source, F.lit("")) == "Invoice (ai)") & ~F.contains(F.concat(F.coalesce(reference, F.lit("")), F.lit(" ")), F.lit(" box "))


def different_company(name: Column, owner: Column) -> Column:
    """A name of more than company types that doesn't hold the owner's entity."""
    words = entity_tokens(name)
    return (F.size(words) > 0) & ~has_words(words, entity_tokens(owner))


def numeric_tokens(text: Column, places: int) -> Column:
    """All numbers of a text, rounded half up."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1), lambda t: F.round(F.replace(t, F.lit(","), F.lit("")).try_cast("decimal(30,6)"), places).cast(f"decimal(30,{places})")))


def unsafe_flags(flags: Column) -> Column:
    """Flags that say a source row is structurally unsafe, shifted or quarantined."""
    return F.filter(flags, lambda f: F.rlike(normalize_name(f), F.lit("structur|shift|quarant")))


def entry_problem(name: Column, value: Column) -> Column:
    """Why a reviewer's entry is refused; null if it isn't."""
    own = F.trim(value)
    return (
        F.when(name.isin("site", "po", "location", "Item") & ~own.rlike(r"^[1-9]\d{0,14}$"), "must be a whole number").when((name == "location_type") & ~own.isin("Store (S)", "Warehouse (W)"), "must be Store (S) or Warehouse (W)")
        .when((name == "date") & (~own.rlike(r"^\d{4}-\d{2}-\d{2}$") | own.try_cast("date").isNull()), "must be YYYY-MM-DD").when(name.isin("net", "tax", "Unit Cost", "Quantity") & own.try_cast("decimal(38,6)").isNull(), "must be a number")
        .when(F.length(own) > 64, "is too long")
    )


def union_box(words: Column) -> Column:
    """The box about words, as shares of the page to four places; null if it isn't on the page. ``words`` is an array of boxes with page sizes."""

    def shares(corner: str, size: str) -> Column:
        return F.transform(words, lambda w: w[corner] / w[size])

    box = F.array(F.array_min(shares("x0", "width")), F.array_min(shares("top", "height")), F.array_max(shares("x1", "width")), F.array_max(shares("bottom", "height")))
    return F.when(F.forall(box, lambda v: v.between(0, 1)), F.transform(box, lambda v: F.round(v, 4)))


def row_marks(text: Column) -> Column:
    """Amounts with two decimals, and words of four letters or more, of a printed row."""
    own = F.lower(F.coalesce(text, F.lit("")))
    return F.array_union(F.regexp_extract_all(own, F.lit(r"(?<![\d.,])(\d[\d,]*\.\d{2})(?![\d])"), 1), F.regexp_extract_all(own, F.lit("([a-z]{4,})"), 1))


def line_marks(amounts: list[Column], description: Column) -> Column:
    """What tells a line apart on its row: its amounts at cents, with commas and without, and its description's words."""
    forms = F.flatten(F.array(*[F.when(F.coalesce(a, F.lit(0)) != 0, F.array(F.format_number(a, 2), F.replace(F.format_number(a, 2), F.lit(","), F.lit("")))).otherwise(F.array().cast("array<string>")) for a in amounts]))
    return F.array_union(forms, F.regexp_extract_all(F.lower(F.coalesce(description, F.lit(""))), F.lit("([a-z]{4,})"), 1))


def guarded_barcode(printed: Column, from_ai: Column) -> Column:
    """(gtin, unchecked, reason) of a line's barcode: checked digits alone; a local code that fails is kept aside, an AI's cleared."""
    own = classify_barcode(printed)
    failed = own["gtin"].isNull() & own["unchecked"].isNotNull()
    return F.struct(own["gtin"].alias("gtin"), F.when(failed & ~from_ai, own["unchecked"]).alias("unchecked"), F.when(failed & from_ai, "unreadable").otherwise(own["reason"]).alias("reason"))


def picked_sku(words: Column) -> Column:
    """Of the words of an item column the joined ones with letters if there are several, else the best: letters, then marks, then length."""
    own = F.filter(F.transform(words, lambda w: F.replace(F.trim(w), F.lit(" "), F.lit(""))), lambda v: v.rlike(r"^[A-Za-z0-9][A-Za-z0-9./_-]{0,79}$"))
    named = F.filter(own, lambda v: v.rlike("[A-Za-z]"))
    joined = F.array_join(named, "")
    known = F.filter(own, lambda v: ~normalize_name(v).isin("item", "no", "number", "s no", "serial"))
    scored = F.transform(known, lambda v: F.struct((F.when(v.rlike("[A-Za-z]"), 3).otherwise(1) + F.when(v.rlike("[-_/]"), 1).otherwise(0)).alias("score"), F.length(v).alias("n"), v.alias("v")))
    return F.when(F.size(known) == 0, None).when((F.size(named) > 1) & joined.rlike(r"^[A-Za-z0-9][A-Za-z0-9./_-]{0,79}$"), joined).otherwise(F.array_max(scored)["v"])


def split_note(index: Column, count: Column, numbers: Column, pages: Column) -> Column:
    """What a part of a split file says of where it came from."""
    first, last = F.element_at(pages, 1).cast("string"), F.element_at(pages, -1).cast("string")
    span = F.when(F.size(pages) == 1, F.concat(F.lit("page "), first)).otherwise(F.concat(F.lit("pages "), first, F.lit("-"), last))
    return F.concat(F.lit("The uploaded file bound "), count.cast("string"), F.lit(" invoices ("), F.array_join(numbers, ", "), F.lit("). It was split by page; this record is invoice "), index.cast("string"), F.lit(" of "), count.cast("string"), F.lit(" ("), span, F.lit(" of the original file)."))


def self_check(lines: Column, number: Column, net: Column, reconciles: Column, header_fields: Column) -> Column:
    """Why an AI's read fails its own checks."""
    tests = [(lines == 0, "no lines"), (number.isNull() | net.isNull(), "no number or net"), (number.isNotNull() & net.isNotNull() & ~reconciles, "printed line nets do not sum to its net"), (header_fields < 3, "fewer than 3 of number, date, PO, net and tax")]
    return F.array_compact(F.array(*[F.when(t, F.lit(reason)) for t, reason in tests]))
