"""Workbooks (.xlsx) with the standard library: a Python data source for the first sheet, and a writer."""
from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS = 1_048_576  # of a sheet


def _local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def rows_of(data: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as strings."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rid = book.find("m:sheets/m:sheet", NS).get(_REL)
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in links if r.get("Id") == rid)
        sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with z.open(sheet) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{NS['m']}}}row":
                    continue
                out: list[str | None] = []
                for cell in row.iterfind("m:c", NS):
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at - len(out))
                    v = cell.find("m:v", NS)
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        out.append("".join(t.text or "" for t in cell.iter(f"{{{NS['m']}}}t")))
                    elif v is None:
                        out.append(None)
                    else:
                        out.append(shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}.get(v.text, v.text) if kind == "b" else v.text)
                yield out
                row.clear()


class ExcelSource(DataSource):
    """format("tidelake_excel").option("path", ...): header row, then strings."""

    @classmethod
    def name(cls) -> str:
        return "tidelake_excel"

    def _data(self) -> bytes:
        with open(_local(self.options["path"]), "rb") as f:
            return f.read()

    def schema(self) -> StructType:
        from .readers import unique_names

        head = next(rows_of(self._data()), [])
        return StructType([StructField(n, StringType()) for n in unique_names([h or f"column_{i}" for i, h in enumerate(head)])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self, len(schema))


class _Reader(DataSourceReader):
    def __init__(self, source: ExcelSource, width: int):
        self.source, self.width = source, width

    def partitions(self):
        return [InputPartition(0)]  # a zip archive can't be split; a sheet is bounded in rows

    def read(self, partition):
        rows = rows_of(self.source._data())
        next(rows, None)
        for r in rows:
            yield tuple((r + [None] * self.width)[: self.width])


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """One sheet of inline strings and numbers; rows stream through the driver, and a sheet's row bound is checked."""
    def name(i: int) -> str:
        s = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                   '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   f'<sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{NS["m"]}"><sheetData>'.encode())
            n = 0
            for r in [tuple(df.columns)]:
                n += 1
                f.write((f'<row r="{n}">' + "".join(cell(f"{name(i)}{n}", v) for i, v in enumerate(r)) + "</row>").encode())
            for r in df.toLocalIterator():
                n += 1
                if n > MOST_ROWS:
                    raise ValueError("more rows than a sheet holds")
                f.write((f'<row r="{n}">' + "".join(cell(f"{name(i)}{n}", v) for i, v in enumerate(r)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
