"""Measured tables of a document, read in one pass over its sorted rows: what ``tables.measured_tables`` folds.

Headings and cells follow the rules of ``tables.heading_spans`` and ``tables.mapped``, which say them for one row as columns; here they
are told only of rows that can be headings and of rows under one. Patterns are read as Java reads them: blanks and digits are ASCII,
borders of words are not.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa

from ..functions.printed import CURRENCIES, EXACT_ROLES, INVOICE_TITLE, PACKING_TITLE
from ..functions.text import _folding

#: A row as (page, row_no, width, height, x0s, x1s, tops, bottoms, texts).
PAGE, ROW, WIDTH, HEIGHT, LEFT, RIGHT, TOP, BOTTOM, TEXT = range(9)
#: Rows of a batch that is given out.
GIVEN = 10_000

#: Roles that a measured table must have, and what ends one.
NEEDED = ["description", "qty", "price"]
ENDS = r"^(?:total(?: qty| price| in)?|net (?:amount|total)|gross total|discount|amount in words)\b"
FOOTERS = r"^(?:created by|approved by|printed by|payment information|bank name|iban)\b"
#: An invoice number behind its label, and the label of another invoice's.
NUMBER = r"(?i)\b(?:tax\s+)?invoice\s+(?:no\.?|number|#)\s*[:\-]\s*([A-Za-z0-9][A-Za-z0-9./_-]{0,79})\s*$"
OTHER_NUMBER = r"(?i)\b(?:original|related|reference|previous)\s+(?:tax\s+)?invoice\s+(?:no\.?|number|#)\s*[:\-]"

_ROLE = {name: role for role, names in reversed(EXACT_ROLES.items()) for name in names}
#: Of the headings of each needed role those that hold no other one: a row without any of them can't have the role.
_SIGNS = [[n for n in EXACT_ROLES[r] if not any(o != n and o in n for o in EXACT_ROLES[r])] for r in NEEDED]

#: Letters that all headings of some needed role have.
_LETTERS = set().union(*[set.intersection(*map(set, EXACT_ROLES[r])) for r in NEEDED])


def _java(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\b", r"(?u:\b)"), re.ASCII)


_ENDS, _FOOTERS, _NUMBER, _OTHER, _PACKING, _INVOICE = map(_java, (ENDS, FOOTERS, NUMBER, OTHER_NUMBER, PACKING_TITLE, INVOICE_TITLE))
_RATE, _CURRENCY = _java(r"(?i)^\s*(?:vat|tax)\s*\d+(?:\.\d+)?\s*%\s*$"), _java(rf"(?i)^\s*amount\s+(?:{CURRENCIES})\s*$")
_PLAIN, _NOT_WORD = re.compile("[^a-z0-9]+"), re.compile(r"[\W_]+")
_MARKS, _BRACKETS, _BLANKS, _THOUSANDS, _AMOUNT = _java(r"(?:AED|KWD|USD|EUR|GBP|SAR|QAR|OMR|BHD)|[$€£]"), _java(r"^\(.*\)$"), _java(r"[(),\s]"), _java(r"\.(?=\d{3}\.)"), _java(r"^[+-]?(\d+)(?:\.\d+)?\Z")
_BARCODE, _COUNT, _SERIAL = _java(r"^\s*[0-9]{8,14}\s*$"), _java(r"^[0-9]{1,6}$"), _java(r"^[0-9]{1,6}\s?$")
_SIZE, _LITRES = _java(r"(?i)\b(\d+)O(\d*)(?=ml\b)"), _java(r"(?<=\d)mI\b")


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    old, new = _folding()
    return {ord(c): new[i] if i < len(new) else None for i, c in enumerate(old)}


def packed(text: str) -> str:
    """``printed.packed`` of a text."""
    if text.isascii():
        return _PLAIN.sub("", text.lower())
    return _NOT_WORD.sub("", text.lower().replace("ß", "ss").translate(_table()))


def exact_role(text: str, own: str) -> str | None:
    """``printed.exact_role`` of a text and its packed form."""
    if "%" in text and _RATE.search(text):
        return "tax_amount"
    if own.startswith("amount") and _CURRENCY.search(text):
        return "other_amount"
    return _ROLE.get(own)


@lru_cache(maxsize=100_000)
def is_amount(value: str | None) -> bool:
    """Whether ``numbers.printed_decimal`` reads a text."""
    if value is None:
        return False
    own = _THOUSANDS.sub("", _BLANKS.sub("", _MARKS.sub("", value.upper())))
    found = _AMOUNT.match(own)
    return bool(found) and len(found.group(1).lstrip("0")) <= 32


def _joined(texts: list) -> str:
    try:
        return " ".join(texts)
    except TypeError:
        return " ".join(t for t in texts if t is not None)


def _known(values: list) -> list:
    return [v for v in values if v == v]


def may_head(text: str) -> bool:
    """Whether a row's text holds a heading of each needed role."""
    if text.isascii() and not _LETTERS.issubset(text.lower()):
        return False
    own = packed(text)
    return all(any(sign in own for sign in signs) for signs in _SIGNS)


@lru_cache(maxsize=10_000)
def headings(texts: tuple) -> list[tuple[str, int, int]]:
    """(role, first word, word behind) of each role's widest, then first heading. Pages of one layout have the same."""
    widest: dict[str, tuple] = {}
    for width in (3, 2, 1):
        for s in range(len(texts) - width + 1):
            text = _joined(texts[s : s + width])
            role = exact_role(text, packed(text))
            if role is not None:
                widest.setdefault(role, (role, s, s + width))
    return list(widest.values())


def heading_spans(row: tuple) -> list[tuple]:
    """(left, right, role) of a row's headings, as ``tables.heading_spans`` has them."""
    best = []
    for role, s, e in headings(tuple(row[TEXT])):
        left, right = _known(row[LEFT][s:e]), _known(row[RIGHT][s:e])
        best.append((min(left) if left else math.nan, max(right) if right else math.nan, role))
    return sorted(h for h in best if not any(o[0] <= h[0] and o[1] >= h[1] and o[1] - o[0] > h[1] - h[0] for o in best))


def borders(spans: list[tuple]) -> list[float]:
    """``tables.borders`` of a heading's spans."""
    out = []
    for a, b in zip(spans, spans[1:], strict=False):
        gap = max(0.0, b[0] - a[1])
        out.append(b[0] - min(3.0, gap * 0.08) if a[2] == "description" else a[1] + min(gap / 2, max(4.0, (a[1] - a[0]) * 0.15)) if a[2] == "sku" else a[1] + gap / 2)
    return out


def cells_of(row: tuple, spans: list[tuple], cuts: list[float]) -> dict[str, str | None]:
    """``tables.mapped``: texts by role under the spans in force, a barcode and a quantity beside their columns put back."""
    rights, texts, last = row[RIGHT], row[TEXT], len(cuts)
    columns: list[list[int]] = [[] for _ in spans]
    rising = all(a <= b for a, b in zip(cuts, cuts[1:], strict=False))
    for k, (a, b) in enumerate(zip(row[LEFT], rights, strict=True)):
        centre = (a + b) / 2
        if rising:
            if centre == centre:
                columns[bisect_right(cuts, centre)].append(k)
            continue
        for i, own in enumerate(columns):
            if (not i or centre >= cuts[i - 1]) and (i == last or centre < cuts[i]):
                own.append(k)
    out: dict[str, str | None] = {}
    for (_, _, role), own in zip(spans, columns, strict=True):
        out[role] = _text(role, [texts[k] for k in own]) if own else None
    for i in range(last):
        role, after = spans[i][2], spans[i + 1][2]
        if role == "description" and after == "gtin" and columns[i] and not columns[i + 1]:
            reaching = [k for k in columns[i] if rights[k] > spans[i + 1][0] and texts[k] is not None and _BARCODE.search(texts[k])]
            if len(reaching) == 1:
                out["gtin"] = texts[reaching[0]].strip(" ")
                out[role] = _text(role, [texts[k] for k in columns[i] if _word(row, k) != _word(row, reaching[0])])
        elif role == "qty" and after == "price" and not columns[i] and len(columns[i + 1]) >= 2:
            first, *rest = columns[i + 1]
            if texts[first] is not None and _COUNT.search(texts[first].strip(" ")) and rights[first] < spans[i + 1][0] and any(is_amount(texts[k]) for k in rest):
                out[role] = texts[first].strip(" ")
                out[after] = _text(after, [texts[k] for k in rest if _word(row, k) != _word(row, first)])
    return out


def _word(row: tuple, k: int) -> tuple:
    return row[LEFT][k], row[RIGHT][k], row[TOP][k], row[BOTTOM][k], row[TEXT][k]


def _text(role: str, texts: list[str | None]) -> str | None:
    """A cell's text; a size's ``3OML`` is ``30ML`` in a description."""
    text = " ".join([t.strip(" ") for t in texts if t is not None]).strip(" ") or None
    if role == "description" and text is not None and ("ml" in text.lower()):
        text = _LITRES.sub("ml", _SIZE.sub(r"\g<1>0\2", text))
    return text


def _stop(text: str) -> str | None:
    if text[:1].isascii() and text[:1].isalnum() and text[:1].lower() not in "tngdacpbi":
        return None
    own = _PLAIN.sub(" ", text.lower()).strip(" ")
    return "total" if _ENDS.match(own) else "footer" if _FOOTERS.match(own) else None


def _number(own: list[tuple], texts: list[str]) -> str | None:
    """``tables.measured_number`` of a page."""
    found = set()
    for row, text in zip(own, texts, strict=True):
        if not row[TEXT] or "invoice" not in text.lower():
            continue
        tops = _known(row[TOP])
        if tops and min(tops) <= row[HEIGHT] / 3 and not _OTHER.search(text):
            behind = _NUMBER.search(text)
            if behind:
                found.add(behind.group(1))
    return found.pop() if len(found) == 1 else None


def _middle(row: tuple) -> float:
    return sum([(a + b) / 2 for a, b in zip(row[TOP], row[BOTTOM], strict=True)]) / len(row[TOP])


def _tallest(row: tuple) -> float:
    return max([b - a if b - a > 1.0 else 1.0 for a, b in zip(row[TOP], row[BOTTOM], strict=True)])


def _same(a: float, b: float) -> bool:
    return a == b or a != a and b != b


class _Table:
    """A heading in force: its spans, whether totals ended it, and the line that rows are joined to."""

    def __init__(self, page: int, spans: list[tuple]) -> None:
        self.page, self.spans, self.cuts = page, spans, borders(spans)
        self.total, self.ended = False, None
        self.full: tuple | None = None
        self.line: list | None = None

    def stopped(self, page: int, stop: str | None) -> bool:
        """Whether totals above or a footer of the page end the table, once this row is told."""
        if stop is not None:
            self.ended = page
            self.total = self.total or stop == "total"
        return self.total or self.ended == page

    def add(self, row: tuple) -> list | None:
        """The line that a row begins."""
        cells = cells_of(row, self.spans, self.cuts)
        get = cells.get
        if is_amount(get("price")) and (is_amount(get("qty")) or is_amount(get("net_amount"))) and any(get(c) is not None for c in ("sku", "gtin", "part_code", "description")):
            shown, last = get("serial"), self.full
            serial = int(shown) if shown is not None and _SERIAL.search(shown) else None
            self.full = (row[PAGE], serial)
            if last is None or last[0] == row[PAGE] or serial is not None and last[1] is not None and serial == last[1] + 1:
                self.line = [row[PAGE], self.page, row[ROW], cells, [get("description")], row]
                return self.line
        line = self.line
        if line is not None:
            wraps = get("description") is not None and not any(is_amount(get(c)) for c in ("qty", "price", "net_amount", "tax_amount"))
            if wraps and line[0] == row[PAGE] and _middle(row) - _middle(line[-1]) <= max(12.0, _tallest(row) * 2.4):
                line[-2].append(get("description"))
                line[-1] = row
            else:
                self.line = None
        return None


def lines(rows: list[tuple]) -> list[tuple]:
    """(page, header_page, row_no, cells) of a document's sorted rows."""
    found: list[list] = []
    table: _Table | None = None
    last = None
    for page, grouped in groupby(rows, key=itemgetter(PAGE)):
        own = list(grouped)
        texts = [_joined(r[TEXT]) for r in own]
        whole = "\n".join(texts)
        low = whole.lower()
        if "packing" in low:
            if _PACKING.search(whole) and not _INVOICE.search(whole):
                continue
        filled = [(r, t) for r, t in zip(own, texts, strict=True) if r[TEXT]]
        if not filled:
            continue
        heads = {}
        for i, (row, text) in enumerate(filled):
            if len(row[TEXT]) >= len(NEEDED) and may_head(text):
                spans = heading_spans(row)
                if {s[2] for s in spans}.issuperset(NEEDED):
                    heads[i] = spans
        number, (width, height) = _number(own, texts) if "invoice" in low else None, filled[0][0][WIDTH : HEIGHT + 1]
        follows = not heads and last is not None and page == last[0] + 1 and number is not None and number == last[1] and _same(width, last[2]) and _same(height, last[3])
        last = page, number, width, height
        if not follows:
            table = None
        for i, (row, text) in enumerate(filled):
            if i in heads:
                table = _Table(page, heads[i])
                table.stopped(page, _stop(text))
            elif table is not None and not table.total and not table.stopped(page, _stop(text)):
                line = table.add(row)
                if line is not None:
                    found.append(line)
    out = []
    for page, header, row_no, cells, described, _ in found:
        cells["description"] = "\n".join([d for d in described if d is not None]) or None
        out.append((page, header, row_no, cells))
    return out


def _numbers(column: pa.Array) -> list:
    """Python numbers; a missing one is NaN."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _lists(column: pa.ListArray, values: Callable[[pa.Array], list]) -> list[list]:
    """Each row's list, cut from all values at once; a missing list is empty."""
    ends = column.offsets.to_pylist()
    flat, first = values(column.flatten()), ends[0]
    if column.null_count:
        return [x or [] for x in column.to_pylist()] if values is pa.Array.to_pylist else [[math.nan if v is None else v for v in x or []] for x in column.to_pylist()]
    return [flat[a - first : b - first] for a, b in zip(ends, ends[1:], strict=False)]


def fold(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc, page, row_no, width, height, x0, x1, top, bottom, text), a document's rows together and sorted, to ``schema``."""

    def given(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([list(m.items()) for m in c] if pa.types.is_map(f.type) else c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in batches:
            docs, pages, numbers = (batch.column(i).to_pylist() for i in range(3))
            sizes = [_numbers(batch.column(i)) for i in (3, 4)]
            words = [_lists(batch.column(i), _numbers) for i in range(5, 9)] + [_lists(batch.column(9), pa.Array.to_pylist)]
            for doc, row in zip(docs, zip(pages, numbers, *sizes, *words, strict=True), strict=True):
                if doc != key and group:
                    out += [(key, *line) for line in lines(group)]
                    group = []
                    if len(out) >= GIVEN:
                        yield given(out)
                        out = []
                key = doc
                group.append(row)
        if group:
            out += [(key, *line) for line in lines(group)]
        if out:
            yield given(out)

    return run
