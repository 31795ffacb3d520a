"""Workbooks without other libraries: XLSX and ODS sheets to rows, and frames to XLSX.

A file is read in one task, as a workbook can't be split; its expanded size is bounded and document types are refused.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_EXPANDED, MOST_COLUMNS, MOST_ROWS = 30 << 20, 80, 50_000
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
TABLE, TEXT, OFFICE = ("{urn:oasis:names:tc:opendocument:xmlns:" + n + ":1.0}" for n in ("table", "text", "office"))


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:2000]:
        raise ValueError("document types are refused")
    return ElementTree.fromstring(data)


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n


def _xlsx(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, list[str | None]]]:
    shared = [] if "xl/sharedStrings.xml" not in archive.namelist() else ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in _part(archive, "xl/sharedStrings.xml").iter(f"{MAIN}si")]
    targets = {x.get("Id"): x.get("Target").lstrip("/") for x in _part(archive, "xl/_rels/workbook.xml.rels")}
    for sheet in _part(archive, "xl/workbook.xml").iter(f"{MAIN}sheet"):
        name, target = sheet.get("name"), targets[sheet.get(f"{LINK}id")]
        for number, row in enumerate(_part(archive, target if target.startswith("xl/") else f"xl/{target}").iter(f"{MAIN}row"), 1):
            values: list[str | None] = []
            for cell in row.iter(f"{MAIN}c"):
                if cell.find(f"{MAIN}f") is not None:
                    raise ValueError("formulas are refused")
                values += [None] * (_column(cell.get("r", "")) - 1 - len(values))
                v = cell.find(f"{MAIN}v")
                inline = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                values.append(shared[int(v.text)] if cell.get("t") == "s" else inline if cell.get("t") == "inlineStr" else v.text if v is not None else None)
            yield name, int(row.get("r", number)), values


def _ods(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, list[str | None]]]:
    for sheet in _part(archive, "content.xml").iter(f"{TABLE}table"):
        number = 0
        for row in sheet.iter(f"{TABLE}table-row"):
            values: list[str | None] = []
            for cell in row:
                if cell.tag not in (f"{TABLE}table-cell", f"{TABLE}covered-table-cell"):
                    continue
                if cell.get(f"{TABLE}formula"):
                    raise ValueError("formulas are refused")
                # the stored value, not the formatted one; a cell under a merged one is empty and keeps its place
                text = cell.get(f"{OFFICE}value") or cell.get(f"{OFFICE}date-value") or "\n".join("".join(p.itertext()) for p in cell.iter(f"{TEXT}p")) or None
                own = None if cell.tag.endswith("covered-table-cell") else text
                values += [own] * min(int(cell.get(f"{TABLE}number-columns-repeated", 1)), MOST_COLUMNS + 1)
            while values and values[-1] is None:
                values.pop()
            times = int(row.get(f"{TABLE}number-rows-repeated", 1))
            if values and number + times > MOST_ROWS:
                raise ValueError("the workbook has too many rows or columns")
            for _ in range(times if values else 0):
                number += 1
                yield sheet.get(f"{TABLE}name"), number, values
            number += 0 if values else times


def sheet_rows(content: bytes) -> list[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook; blank rows are left out, oversized ones refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if sum(i.file_size for i in archive.infolist()) > MOST_EXPANDED:
            raise ValueError("the workbook expands too far")
        rows = list(_xlsx(archive) if "xl/workbook.xml" in archive.namelist() else _ods(archive))
    if len(rows) > MOST_ROWS or any(len(v) > MOST_COLUMNS for _, _, v in rows):
        raise ValueError("the workbook has too many rows or columns")
    return [(s, n, v) for s, n, v in rows if any(x not in (None, "") for x in v)]


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file on whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()


def sheets_of(frames: dict[str, DataFrame], order: dict[str, list[str]], most: int = MOST_ROWS) -> dict[str, list[list]]:
    """Sheets with a heading row from frames, in order; more rows than a sheet may have are refused, never cut."""
    out = {}
    for name, df in frames.items():
        rows = df.orderBy(*order[name]).limit(most).collect()
        if len(rows) >= most:
            raise ValueError(f"{name} has too many rows")
        out[name] = [df.columns, *[[int(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r] for r in rows]]
    return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_no, cells, problem): a file that can't be read is a row with its problem."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame.path, frame.content, strict=True):
                try:
                    rows = [(name, s, n, v, None) for s, n, v in sheet_rows(content)]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [(name, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells", "problem"]).astype({"row_no": "Int32"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sheet string, row_no int, cells array<string>, problem string")


def by_headings(rows: DataFrame, sheet: str) -> DataFrame:
    """(path, row_no, data) of a sheet's rows below its first one, whose cells name the columns in capitals; blank rows are left out."""
    own = rows.where(F.upper(F.trim("sheet")) == sheet.upper())
    heads = own.where("row_no = 1").select("path", F.transform("cells", lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))).alias("heads"))
    joined = own.where("row_no > 1").join(F.broadcast(heads), "path")
    pairs = F.filter(F.arrays_zip("heads", "cells"), lambda z: F.coalesce(z["heads"], F.lit("")) != "")
    return joined.select("path", "row_no", F.map_from_entries(F.transform(pairs, lambda z: F.struct(z["heads"], F.trim(z["cells"])))).alias("data"))


def write_xlsx(sheets: dict[str, list[list]], path: str | io.BytesIO) -> None:
    """Sheets of rows; whole numbers are numbers, anything else is text, so that no cell becomes a formula."""

    def cell(value: object) -> str:
        if isinstance(value, int) and not isinstance(value, bool):
            return f"<c><v>{value}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if value is None else str(value))}</t></is></c>'

    space = MAIN[1:-1]
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        archive.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        archive.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{link}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="{link}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{link}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        archive.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
            archive.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{space}"><sheetData>{body}</sheetData></worksheet>')
