"""Workbooks (.xlsx) on the standard library: a Spark data source in row and in cell mode, a writer, and cell updates.

    spark.dataSource.register(XlsxSource)
    spark.read.format("xlsx").option("sheet", "Tasks").load(path)          # header row gives the columns, plus _row
    spark.read.format("xlsx").option("mode", "cells").load(path)           # row, col, value of every cell
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

# The namespaces of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_M = f"{{{_MAIN}}}"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


class WorkbookError(ValueError):
    """A workbook that cannot be read, or a sheet it does not have."""


def column_number(ref: str) -> int:
    """1 for A, 27 for AA; digits are left out of account."""
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n


def column_name(n: int) -> str:
    """A for 1."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheets(z: zipfile.ZipFile) -> dict[str, str]:
    """Part of each sheet by its name, in order."""
    try:
        book, rels = ET.fromstring(z.read("xl/workbook.xml")), ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    except KeyError as e:
        raise WorkbookError(f"no workbook: {e}") from e
    to = {r.get("Id"): r.get("Target", "") for r in rels}
    out = {}
    for s in book.iter(f"{_M}sheet"):
        target = to.get(s.get(f"{{{_REL}}}id"), "")
        out[s.get("name", "")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def _part(z: zipfile.ZipFile, sheet: str | None) -> str:
    parts = _sheets(z)
    if not parts or sheet and sheet not in parts:
        raise WorkbookError(f"no sheet {sheet!r}")
    return parts[sheet] if sheet else next(iter(parts.values()))


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise WorkbookError("no workbook") from e


def cells(data: bytes, sheet: str | None = None) -> Iterator[tuple[int, int, str | None]]:
    """(row, column, value) of every cell of a sheet, both from 1; the first sheet by default. Streams: no sheet is held whole.

    Values are texts: numbers as written, booleans TRUE or FALSE, formulas by their stored result, errors and empty cells null.
    """
    z = _open(data)
    strings: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for _, e in ET.iterparse(z.open("xl/sharedStrings.xml")):
            if e.tag == f"{_M}si":
                strings.append("".join(t.text or "" for t in e.iter(f"{_M}t")))
                e.clear()
    row, col = 0, 0
    with z.open(_part(z, sheet)) as f:
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start":
                if e.tag == f"{_M}row":
                    row, col = int(e.get("r") or row + 1), 0
                continue
            if e.tag == f"{_M}c":
                col = column_number(re.sub(r"\d", "", e.get("r"))) if e.get("r") else col + 1
                kind, v = e.get("t", "n"), e.find(f"{_M}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in e.iter(f"{_M}t"))
                elif v is None or v.text is None or kind == "e":
                    value = None
                elif kind == "s":
                    value = strings[int(v.text)]
                elif kind == "b":
                    value = "TRUE" if v.text == "1" else "FALSE"
                else:
                    value = v.text
                yield row, col, value
            elif e.tag == f"{_M}row":
                e.clear()


def rows(data: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(row, values from the first column on) of every row that has cells."""
    now, out = None, []
    for r, c, v in cells(data, sheet):
        if r != now:
            if now is not None:
                yield now, out
            now, out = r, []
        out += [None] * (c - len(out))
        out[c - 1] = v
    if now is not None:
        yield now, out


class XlsxSource(DataSource):
    """Options: path, sheet (the first by default), mode (rows or cells). One partition a file, as a workbook is one zip archive."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _paths(self) -> list[str]:
        import glob

        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        return sorted(glob.glob(path)) or [path]

    def schema(self) -> StructType:
        if self.options.get("mode") == "cells":
            return StructType([StructField("row", LongType()), StructField("col", LongType()), StructField("value", StringType())])
        with open(self._paths()[0], "rb") as f:
            head = next(rows(f.read(), self.options.get("sheet")), (0, []))[1]
        names, seen = [], {}
        for i, h in enumerate(head):
            h = h if h not in (None, "") else f"_c{i}"
            seen[h] = seen.get(h, -1) + 1
            names.append(h if not seen[h] else f"{h}.{seen[h]}")
        return StructType([StructField("_row", LongType()), *[StructField(n, StringType()) for n in names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._paths(), self.options.get("sheet"), self.options.get("mode") == "cells", len(schema.fields))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], sheet: str | None, by_cell: bool, width: int):
        self.paths, self.sheet, self.by_cell, self.width = paths, sheet, by_cell, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            data = f.read()
        if self.by_cell:
            yield from cells(data, self.sheet)
            return
        body = rows(data, self.sheet)
        next(body, None)
        for r, values in body:
            if any(v is not None for v in values):
                yield (r, *(values + [None] * self.width)[: self.width - 1])


def read(spark: SparkSession, path: str, sheet: str | None = None, by_cell: bool = False) -> DataFrame:
    """A workbook's rows (header names, _row) or cells (row, col, value)."""
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("xlsx").option("mode", "cells" if by_cell else "rows")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def _cell(ref: str, value: object, style: str = "") -> str:
    if value is None or isinstance(value, float) and value != value:
        return f"<c r={quoteattr(ref)}{style}/>" if style else ""
    if isinstance(value, bool):
        return f'<c r="{ref}"{style} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"{style}><v>{value!r}</v></c>'
    return f'<c r="{ref}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(value)))}</t></is></c>'


def encode(header: list[str], body, sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet: a header row, then the rows of ``body``."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACK}"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name={quoteattr(sheet[:31])} sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACK}"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            for i, row in enumerate([header, *body] if isinstance(body, list) else _chain(header, body), 1):
                f.write(f'<row r="{i}">{"".join(_cell(f"{column_name(j)}{i}", v) for j, v in enumerate(row, 1))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _chain(header, body):
    yield header
    yield from body


def write(df: DataFrame, path: str, sheet: str = "Task Summary") -> None:
    """``df`` as a workbook of one sheet, in its order.

    Rows stream to the driver a partition at a time; a sheet holds 1,048,576 rows, and more raise WorkbookError.
    """
    def body():
        for i, r in enumerate(df.toLocalIterator()):
            if i >= 1_048_575:
                raise WorkbookError("more rows than a sheet holds")
            yield tuple(r)

    with open(path, "wb") as f:
        f.write(encode(df.columns, body(), sheet))


def update(source: str, target: str, values: dict[tuple[int, int], object], sheet: str | None = None) -> None:
    """A copy of a workbook with cells (row, column) replaced; everything else, styles included, stays as it is."""
    with open(source, "rb") as f:
        z = _open(f.read())
    part = _part(z, sheet)
    ET.register_namespace("", _MAIN)
    tree = ET.fromstring(z.read(part))
    data = tree.find(f"{_M}sheetData")
    by_row = {int(r.get("r")): r for r in data}
    for (r, c), value in sorted(values.items()):
        if r not in by_row:
            by_row[r] = ET.Element(f"{_M}row", r=str(r))
            data.insert(sum(k < r for k in by_row if k != r), by_row[r])
        row, ref = by_row[r], f"{column_name(c)}{r}"
        at = {column_number(re.sub(r"\d", "", e.get("r"))): e for e in row}
        old = at.get(c)
        style = f' s="{old.get("s")}"' if old is not None and old.get("s") else ""
        new = ET.fromstring(f'<x xmlns="{_MAIN}">{_cell(ref, value, style)}</x>')
        place = list(row).index(old) if old is not None else sum(k < c for k in at)
        if old is not None:
            row.remove(old)
        for e in new:
            row.insert(place, e)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for item in z.infolist():
            out.writestr(item, ET.tostring(tree, xml_declaration=True, encoding="UTF-8") if item.filename == part else z.read(item.filename))
