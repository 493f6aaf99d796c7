"""Exports for people: one CSV file with a byte-order mark, or one XLSX sheet. Rows stream through the driver one
partition at a time; the distributed form is an ordinary ``df.write``."""

from __future__ import annotations

import csv
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from yakinma.operators.kpi import recency, selected
from yakinma.schema import COLUMNS

SHEET = "Şikâyetler"


def _ordered(df: DataFrame, company: str | None, start: str | None, end: str | None) -> DataFrame:
    return selected(df, company, start, end).orderBy(*recency()).select(*COLUMNS)


def write_csv(df: DataFrame, path: str, company: str | None = None, start: str | None = None, end: str | None = None) -> int:
    n = 0
    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(COLUMNS)
        for row in _ordered(df, company, start, end).toLocalIterator(prefetchPartitions=True):
            w.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def _letter(i: int) -> str:
    return chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26)


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f'<c r="{ref}"><v>{v}</v></c>'
    text = "".join(c for c in str(v) if c in "\t\n\r" or ord(c) >= 32)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_xlsx(df: DataFrame, path: str, company: str | None = None, start: str | None = None, end: str | None = None) -> int:
    """A minimal workbook: frozen header, filter over all columns, text cells inline."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    pack = "http://schemas.openxmlformats.org/package/2006"
    n = 1
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            say = lambda s: f.write(s.encode("utf-8"))
            say(f'{head}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>')
            say('<row r="1">' + "".join(_cell(f"{_letter(i)}1", c) for i, c in enumerate(COLUMNS)) + "</row>")
            for row in _ordered(df, company, start, end).toLocalIterator(prefetchPartitions=True):
                n += 1
                say(f'<row r="{n}">' + "".join(_cell(f"{_letter(i)}{n}", v) for i, v in enumerate(row)) + "</row>")
            say(f'</sheetData><autoFilter ref="A1:{_letter(len(COLUMNS) - 1)}{n}"/></worksheet>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{SHEET}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        )
    return n - 1
