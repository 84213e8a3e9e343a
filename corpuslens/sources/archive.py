"""The news archive's spreadsheets as a Spark data source: ``spark.read.format("news_archive")``.

A folder's workbooks are dealt to partitions by size.  A workbook's XML is read as a stream, a row at a time, and its shared strings lie in
a temporary file, so memory doesn't grow with the sheet.  Comparisons of ``date`` with a text are pushed down: other rows are
dropped before they leave the reader.  Files are opened by pyarrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import json
import operator
import posixpath
import re
import tempfile
import uuid
import zipfile
from array import array
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

# Headings of the news archive's spreadsheets.
HEADINGS = {
    "뉴스 식별자": "news_id", "일자": "date", "언론사": "publisher", "기고자": "author", "제목": "title", "본문": "body",
    "키워드": "keywords", "URL": "url", "통합 분류1": "category1", "통합 분류2": "category2", "통합 분류3": "category3", "사건/사고 분류1": "event_category",
}
# Names of spreadsheet XML.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
_SHEET = re.compile(r"xl/worksheets/sheet(\d+)\.xml")
_CELL = re.compile("([A-Z]+)")


def _column_number(ref: str) -> int:
    n = 0
    for letter in _CELL.match(ref)[1]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _elements(stream, *names: str) -> Iterator[ElementTree.Element]:
    """Elements of these names as they end; each goes from its parent afterwards."""
    parents, wanted = [], {f"{{{_MAIN}}}{n}" for n in names}
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if element.tag in wanted:
            yield element
            if parents:
                parents[-1].clear()


class SharedStrings:
    """A workbook's shared strings, by number, in a temporary file."""

    def __init__(self, book: zipfile.ZipFile):
        self.file, self.ends = tempfile.TemporaryFile(), array("Q", [0])
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:
                for item in _elements(stream, "si"):
                    raw = "".join(x.text or "" for x in item.iter(f"{{{_MAIN}}}t")).encode()
                    self.file.write(raw)
                    self.ends.append(self.ends[-1] + len(raw))

    def __getitem__(self, number: int) -> str:
        self.file.seek(self.ends[number])
        return self.file.read(self.ends[number + 1] - self.ends[number]).decode()


def active_sheet(book: zipfile.ZipFile) -> str:
    """The member of the sheet that is shown when the workbook is opened; without a list of sheets the one of the lowest number."""
    names = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        view = root.find(f"{{{_MAIN}}}bookViews/{{{_MAIN}}}workbookView")
        sheets = root.findall(f"{{{_MAIN}}}sheets/{{{_MAIN}}}sheet")
        chosen = int(view.get("activeTab", 0)) if view is not None else 0
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{{{_PACKAGE}}}Relationship")}
        if chosen < len(sheets):
            target = targets.get(sheets[chosen].get(f"{{{_LINKS}}}id"), "")
            name = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            if name in names:
                return name
    return min((n for n in names if _SHEET.fullmatch(n)), key=lambda n: int(_SHEET.fullmatch(n)[1]))


def spreadsheet_rows(file) -> Iterator[dict[str, str]]:
    """Rows of the active sheet of a workbook (a file that can seek) as {heading: text}; blank rows are skipped, missing cells are empty."""
    with zipfile.ZipFile(file) as book:
        shared, headings = SharedStrings(book), None
        with book.open(active_sheet(book)) as stream:
            for row in _elements(stream, "row"):
                cells: dict[int, str] = {}
                for i, cell in enumerate(row.iter(f"{{{_MAIN}}}c")):
                    kind, value = cell.get("t"), cell.find(f"{{{_MAIN}}}v")
                    if kind == "inlineStr":
                        found = "".join(x.text or "" for x in cell.iter(f"{{{_MAIN}}}t"))
                    elif value is None or value.text is None:
                        found = ""
                    else:
                        found = shared[int(value.text)] if kind == "s" else re.sub(r"^(\d+)\.0$", r"\1", value.text)
                    cells[_column_number(cell.get("r")) if cell.get("r") else i] = found.strip()
                if headings is None:
                    headings = {i: h for i, h in cells.items() if h}
                elif any(cells.values()):
                    yield {h: cells.get(i, "") for i, h in headings.items()}


def iso_date(raw: str) -> str:
    """Eight digits, parted or not, as an ISO date; anything else as it is."""
    digits = re.sub("[-/.]", "", raw.strip())
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:]}" if re.fullmatch("[0-9]{8}", digits) else raw.strip()


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


#: Bytes of workbooks for each partition, rows for each batch.
_PARTITION_BYTES, _BATCH_ROWS = 32 << 20, 1000
_COMPARE = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


class Files(ds.InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.headings, self.names = options["path"], json.loads(options.get("headings", "null")) or HEADINGS, names
        self.dates: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _COMPARE and f.attribute == ("date",) and isinstance(f.value, str):
                self.dates.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, path = _opened(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(path))
        out, total = [], _PARTITION_BYTES
        for file in sorted((x for x in found if x.type == pafs.FileType.File and x.path.lower().endswith(".xlsx")), key=lambda x: x.path):
            if total + file.size > _PARTITION_BYTES:
                out.append(Files([]))
                total = 0
            out[-1].paths.append(file.path)
            total += file.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        tests = [(_COMPARE[kind], value) for kind, value in self.dates]
        for path in partition.paths:
            rows = []
            with store.open_input_file(path) as file:
                for line, cells in enumerate(spreadsheet_rows(file)):
                    row = {name: cells.get(heading) for heading, name in self.headings.items()}
                    row |= {"path": path, "line": line, "date_raw": row.get("date"), "cells": list(cells.items())}
                    row["date"] = iso_date(row.get("date") or "")
                    if all(test(row["date"], value) for test, value in tests):
                        rows.append(row)
                    if len(rows) == _BATCH_ROWS:
                        yield self._batch(rows)
                        rows = []
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"line": pa.int32(), "cells": pa.map_(pa.string(), pa.string())}
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in self.names], self.names)


class Written(ds.WriterCommitMessage):
    def __init__(self, parts: list[str]):
        self.parts = parts


class ArchiveWriter(ds.DataSourceArrowWriter):
    """A workbook for each task that has rows, with inline strings; they get their names once all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex
        self.headings = {name: heading for heading, name in (json.loads(options.get("headings", "null")) or HEADINGS).items()}

    def write(self, batches) -> Written:
        store, folder = _opened(self.path)
        part, file, line = f"{folder}/.{self.run}-{uuid.uuid4().hex}", None, 1

        def row(values: list) -> bytes:
            cell = lambda x: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", " ", x or ""), {"\r": "&#13;"})}</t></is></c>'
            return f"<row>{''.join(map(cell, values))}</row>".encode()

        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                store.create_dir(folder)
                file = store.open_output_stream(part)
                book = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                sheet = book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
                sheet.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode() + row([self.headings.get(n, n) for n in batch.schema.names]))
            for values in zip(*(batch.column(i).cast(pa.string()).to_pylist() for i in range(batch.num_columns))):
                sheet.write(row(values))
                line += 1
        if file is None:
            return Written([])
        sheet.write(b"</sheetData></worksheet>")
        sheet.close()
        book.close()
        file.close()
        return Written([part])

    def commit(self, messages) -> None:
        store, folder = _opened(self.path)
        store.create_dir(folder)
        if self.overwrite:
            for old in store.get_file_info(pafs.FileSelector(folder)):
                if old.path.endswith(".xlsx"):
                    store.delete_file(old.path)
        for i, part in enumerate(p for m in messages if m for p in m.parts):
            store.move(part, f"{folder}/archive-{self.run}-{i:05d}.xlsx")

    def abort(self, messages) -> None:
        store, _ = _opened(self.path)
        for part in (p for m in messages if m for p in m.parts):
            store.delete_file(part)


class NewsArchive(ds.DataSource):
    """Options: ``path``, a workbook or a folder of them; ``headings``, JSON of heading to column name."""

    @classmethod
    def name(cls) -> str:
        return "news_archive"

    def _names(self) -> list[str]:
        headings = json.loads(self.options.get("headings", "null")) or HEADINGS
        return ["path", "line", *dict.fromkeys([*headings.values(), "date"]), "date_raw", "cells"]

    def schema(self) -> str:
        kinds = {"line": "int", "cells": "map<string,string>"}
        return ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in self._names())

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options), self._names())

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark offer its filters to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NewsArchive)
