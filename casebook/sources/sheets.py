"""Workbooks as a data source (S1, S7, S8, K7): sheets are parsed and written by tasks, row by row, without a spreadsheet library.

A workbook is a zip of XML parts.  Reading pulls rows out of the sheet's part one after another, so a task holds a batch of rows and the shared
strings; a sheet that tells its size is read in ranges of ``rows`` rows, a partition each.  Every cell is text, as it is stored, or null.  The first
row names the columns: blank names become ``column_<k>``, repeated ones get a number, as readers of sheets do.  ``row_num`` counts a sheet's rows from 1.

Writing streams one workbook from one task into a file beside the target, which takes its place when the job commits.  Rows beyond what a sheet holds go
on in further sheets with the same header; ``sheet`` ``*`` reads all sheets as one table.  Paths may be those of any store that Arrow opens.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, LongType, NumericType, StringType, StructField, StructType

FORMAT = "casebook_sheet"
#: What stands for all sheets; no sheet can have this name.
ALL = "*"
#: Rows of a partition and of a batch, and rows that a sheet holds beside its header.
ROWS, BATCH, MOST_ROWS = 50_000, 5_000, 1_048_575
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def _name(element) -> str:
    return element.tag.rpartition("}")[2]


class Book:
    """An open workbook."""

    def __init__(self, path: str):
        files, place = _store(path)
        self.file = files.open_input_file(place)
        self.zip = zipfile.ZipFile(self.file)

    def __enter__(self) -> Book:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()

    def _elements(self, part: str, *wanted: str) -> Iterator:
        """Elements of a part by local name, each forgotten once it was used."""
        with self.zip.open(part) as stream:
            path = []
            for event, element in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    path.append(element)
                    continue
                path.pop()
                if _name(element) in wanted:
                    yield element
                    element.clear()
                    if path:
                        path[-1].remove(element)

    def parts(self, sheet: str | int) -> list[str]:
        """The parts of all sheets for ``*``, or else of the one that is meant."""
        return [self.part(k) for k in range(sum(1 for _ in self._elements("xl/workbook.xml", "sheet")) or 1)] if sheet == ALL else [self.part(sheet)]

    def part(self, sheet: str | int) -> str:
        """The part of a sheet, by its name or its place from 0."""
        found = [(e.get("name"), e.get(f"{{{_OFFICE}}}id") or next(v for k, v in e.attrib.items() if k.endswith("}id"))) for e in self._elements("xl/workbook.xml", "sheet")]
        named = dict(found)
        if isinstance(sheet, str) and sheet not in named and not sheet.isdigit():
            raise ValueError(f"no sheet {sheet!r}; there are: {', '.join(named)}")
        if not found:
            raise ValueError("a workbook without sheets")
        key = named[sheet] if sheet in named else found[int(sheet)][1]
        target = next(e.get("Target") for e in self._elements("xl/_rels/workbook.xml.rels", "Relationship") if e.get("Id") == key)
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def strings(self) -> list[str]:
        """Shared strings; what is only a reading aid is no part of them."""
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        out = []
        for item in self._elements("xl/sharedStrings.xml", "si"):
            out.append("".join(t.text or "" for part in item for t in ([part] if _name(part) == "t" else part if _name(part) == "r" else ()) if _name(t) == "t"))
        return out

    def rows(self, part: str, strings: list[str]) -> Iterator[tuple[int, list[str | None]]]:
        """Number and cells of each row that the part has."""
        number = 0
        for row in self._elements(part, "row"):
            number = int(row.get("r") or number + 1)
            cells: list[str | None] = []
            for cell in row:
                if _name(cell) != "c":
                    continue
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                cells.append(_value(cell, strings))
            yield number, cells

    def last(self, part: str) -> int | None:
        """The last row, where the sheet tells it before its rows."""
        with self.zip.open(part) as stream:
            for _, element in ElementTree.iterparse(stream, ("start",)):
                if _name(element) == "dimension":
                    found = re.search(r"(\d+)$", element.get("ref") or "")
                    return int(found[1]) if found else None
                if _name(element) == "row":
                    return None
        return None


def _column(ref: str) -> int:
    out = 0
    for c in ref:
        if not c.isalpha():
            break
        out = out * 26 + ord(c.upper()) - 64
    return out - 1


def _value(cell, strings: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _name(t) == "t")
    raw = next((v.text for v in cell if _name(v) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(raw)]
    return {"1": "true", "0": "false"}.get(raw, raw) if kind == "b" else raw


def named(cells: list[str | None]) -> list[str]:
    """Names of columns by the first row."""
    out: list[str] = []
    for k, cell in enumerate(cells):
        name = (cell or "").strip() or f"column_{k + 1}"
        times = sum(o == name or re.fullmatch(re.escape(name) + r"\.\d+", o) is not None for o in out)
        out.append(f"{name}.{times}" if times else name)
    return out


@dataclass
class Rows(InputPartition):
    """Rows of a sheet by number, the last one included."""

    first: int
    last: int | None
    part: str


class SheetReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.sheet, self.each = options["path"], options.get("sheet", "0"), int(options.get("rows", ROWS))
        self.width = len(schema.fields) - 1
        self.schema = schema

    def partitions(self):
        with Book(self.path) as book:
            lasts = [(part, book.last(part)) for part in book.parts(self.sheet)]
        return [rows for part, last in lasts for rows in self._ranges(part, last)]

    def _ranges(self, part: str, last: int | None) -> list[Rows]:
        if last is None:
            return [Rows(1, None, part)]
        return [Rows(a, None if a + self.each > last else a + self.each - 1, part) for a in range(1, last + 1, self.each)]

    def read(self, partition: Rows):
        import pyarrow as pa

        with Book(self.path) as book:
            header, numbers, columns = None, [], [[] for _ in range(self.width)]

            def batch():
                return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=[f.name for f in self.schema.fields])

            for number, cells in book.rows(partition.part, book.strings()):
                if header is None:
                    header = number
                    if self.sheet == ALL and named(cells) != [f.name for f in self.schema.fields[1:]]:
                        raise ValueError(f"{partition.part} has other columns than the first sheet")
                    continue
                if partition.last is not None and number > partition.last:
                    break
                if number < partition.first:
                    continue
                numbers.append(number - header)
                for k, column in enumerate(columns):
                    column.append(cells[k] if k < len(cells) else None)
                if len(numbers) >= BATCH:
                    yield batch()
                    numbers, columns = [], [[] for _ in range(self.width)]
            if numbers:
                yield batch()


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote."""

    path: str
    rows: int


class SheetWriter(DataSourceWriter):
    def __init__(self, options, schema: StructType):
        self.path, self.title, self.most = options["path"], options.get("sheet", "Sheet1"), int(options.get("most", MOST_ROWS))
        self.names = [f.name for f in schema.fields]
        self.kinds = ["b" if isinstance(f.dataType, BooleanType) else "n" if isinstance(f.dataType, NumericType) else "s" for f in schema.fields]

    def write(self, iterator) -> Part:
        from xml.sax.saxutils import escape, quoteattr

        from pyspark import TaskContext

        context = TaskContext.get()
        made = f"{self.path}.part-{context.partitionId()}-{context.taskAttemptId()}"
        files, place = _store(made)

        def cell(kind: str, value) -> str:
            if value is None:
                return "<c/>"
            if kind == "b":
                return f'<c t="b"><v>{int(value)}</v></c>'
            if kind == "n" and value == value and abs(value) != float("inf"):
                return f"<c><v>{value}</v></c>"
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", str(value)))}</t></is></c>'

        n, titles = 0, []
        rows = iter(iterator)
        row = next(rows, None)
        with files.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            while row is not None or not titles:
                titles.append(f"{self.title[:24]} ({len(titles) + 1})" if titles else self.title)
                with book.open(f"xl/worksheets/sheet{len(titles)}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'{xml}<worksheet xmlns="{_MAIN}"><sheetData><row r="1">{"".join(cell("s", c) for c in self.names)}</row>'.encode())
                    own = 0
                    while row is not None and own < self.most:
                        n, own = n + 1, own + 1
                        sheet.write(f'<row r="{own + 1}">{"".join(map(cell, self.kinds, row))}</row>'.encode())
                        row = next(rows, None)
                    sheet.write(b"</sheetData></worksheet>")
            each = range(1, len(titles) + 1)
            book.writestr("[Content_Types].xml", f'{xml}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{"".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in each)}</Types>')
            book.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            book.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{"".join(f'<sheet name={quoteattr(t)} sheetId="{k}" r:id="rId{k}"/>' for k, t in zip(each, titles, strict=True))}</sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{_PACKAGE}/relationships">{"".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in each)}</Relationships>')
        return Part(made, n)

    def commit(self, messages) -> None:
        parts = [m for m in messages if m is not None]
        some = [m for m in parts if m.rows] or parts[:1]
        if len(some) > 1:
            self.abort(messages)
            raise ValueError("a workbook is written by one task")
        for m in parts:
            files, place = _store(m.path)
            if m is some[0]:
                target = _store(self.path)[1]
                if files.get_file_info(target).is_file:
                    files.delete_file(target)
                files.move(place, target)
            else:
                files.delete_file(place)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                files, place = _store(m.path)
                files.delete_file(place)


class SheetSource(DataSource):
    """``spark.read.format(FORMAT).load(path)``; options: ``sheet`` (name, place from 0, or ``*``), ``rows`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        with Book(self.options["path"]) as book:
            first = next(book.rows(book.parts(self.options.get("sheet", "0"))[0], book.strings()), (0, []))
        return StructType([StructField("row_num", LongType()), *(StructField(n, StringType()) for n in named(first[1]))])

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options, schema)
