"""DOCX and XLSX files as documents with text, tables and pages.

The source `office` lists files, plans partitions of some bytes each and takes files apart where
it reads them; texts are normalised and tables tidied as columns, without a shuffle.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import schemas as sc
from ..functions import text as tx
from ..operators.tables import markdown_text, without_empty_rows

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PARTS = "array<struct<style:string,sheet:string,text:string,matrix:array<array<string>>>>"


def _said(node: ElementTree.Element) -> str:
    """The text of a paragraph, with its tabs and line breaks."""
    marks = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n"}
    return "".join(x.text or "" if x.tag == W + "t" else marks[x.tag] for r in node.iter(W + "r") for x in r if x.tag == W + "t" or x.tag in marks)


def _rows(table: ElementTree.Element) -> list[list[str]]:
    """Cells of a table; one over several columns or rows stands in each of them."""
    out: list[list[str]] = []
    for row in table.findall(W + "tr"):
        cells: list[str] = []
        for cell in row.findall(W + "tc"):
            span, merged = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
            said = "\n".join(_said(p) for p in cell.findall(W + "p"))
            if merged is not None and merged.get(W + "val", "continue") == "continue" and out and len(out[-1]) > len(cells):
                said = out[-1][len(cells)]
            cells += [said] * (int(span.get(W + "val", "1")) if span is not None else 1)
        out.append(cells)
    return out


def docx_parts(content: bytes) -> list[tuple]:
    """(style, sheet, text, matrix) of each paragraph and table of a DOCX file, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else ()
    names = {s.get(W + "styleId"): s.find(W + "name").get(W + "val") for s in styles if s.tag == W + "style" and s.find(W + "name") is not None}
    out: list[tuple] = []
    for node in () if body is None else body:
        if node.tag == W + "p":
            style = node.find(f"{W}pPr/{W}pStyle")
            own = style.get(W + "val") if style is not None else ""
            out.append((names.get(own, own).lower(), None, _said(node), None))
        elif node.tag == W + "tbl":
            out.append(("table", None, None, _rows(node)))
    return out


def _column(reference: str) -> int:
    at = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


#: Built-in number formats that show dates or times, and what shows that another one does.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
DATE_LETTERS = re.compile(r"[ymdhs]", re.I)
NOT_LETTERS = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)


def _dated(styles: ElementTree.Element | None) -> set[int]:
    """Numbers of the cell styles whose format shows a date or a time."""
    if styles is None:
        return set()
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(S + "numFmt")}
    shows = lambda n: n in DATE_FORMATS or bool(DATE_LETTERS.search(NOT_LETTERS.sub("", own.get(n, "").split(";")[0])))
    cells = styles.find(S + "cellXfs")
    return {k for k, x in enumerate(() if cells is None else cells) if shows(int(x.get("numFmtId", "0")))}


def _moment(serial: float, since_1904: bool) -> str:
    """A day number as date and time, or as a time alone below one day. Day 60 of 1900 never was: later ones count it."""
    whole = datetime.timedelta(seconds=round(serial * 86400))
    if 0 <= serial < 1:
        return str((datetime.datetime.min + whole).time())
    start = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30 if serial >= 61 else 31)
    return str(start + whole)


def _value(cell: ElementTree.Element, shared: list[str], dated: set[int], since_1904: bool) -> str:
    kind, v = cell.get("t", "n"), cell.find(S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(S + "t"))
    if v is None or v.text is None:
        return ""
    if kind == "n" and int(cell.get("s", "0")) in dated:
        try:
            return _moment(float(v.text), since_1904)
        except (ValueError, OverflowError):
            return v.text
    return {"s": lambda: shared[int(v.text)], "b": lambda: str(v.text == "1"), "d": lambda: v.text.replace("T", " ")}.get(kind, lambda: v.text)()


def xlsx_parts(content: bytes) -> list[tuple]:
    """(style, sheet, text, matrix) of each sheet of an XLSX file, in the workbook's order, rows filled to the widest.

    Cells have the values that are stored; numbers whose cell format shows a date or a time are
    written as such.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
        strings, book = root("xl/sharedStrings.xml"), ElementTree.fromstring(z.read("xl/workbook.xml"))
        shared = ["".join(t.text or "" for t in s.iter(S + "t")) for s in (() if strings is None else strings)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        dated, rules = _dated(root("xl/styles.xml")), book.find(S + "workbookPr")
        since_1904 = rules is not None and rules.get("date1904", "0") in ("1", "true")
        out: list[tuple] = []
        for sheet in book.iter(S + "sheet"):
            rows = []
            for row in ElementTree.fromstring(z.read(posixpath.join("xl", targets[sheet.get(R + "id")]).lstrip("/"))).iter(S + "row"):
                cells: dict[int, str] = {}
                for cell in row.findall(S + "c"):
                    cells[_column(cell.get("r", "")) if cell.get("r") else max(cells, default=-1) + 1] = _value(cell, shared, dated, since_1904)
                rows.append(cells)
            width = max((max(r, default=-1) for r in rows), default=-1) + 1
            out.append(("table", sheet.get("name"), None, [[r.get(i, "") for i in range(width)] for r in rows]))
    return out


def _parts(path: str, content: bytes) -> tuple:
    try:
        return (xlsx_parts if path.lower().endswith(".xlsx") else docx_parts)(content), None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError) as e:
        return [], f"{type(e).__name__}: {e}"


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


class OfficeReader(DataSourceReader):
    """Lists the files under a path and deals them to partitions of about `bytes_per_partition`."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.most = options["path"], int(options.get("bytes_per_partition", 32 << 20))

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))
        found = store.get_file_info(fs.FileSelector(root, recursive=True) if store.get_file_info(root).type == fs.FileType.Directory else [root])
        out, size = [Files([])], 0
        for f in sorted((f for f in found if f.path.lower().endswith((".docx", ".xlsx"))), key=lambda f: f.path):
            if out[-1].paths and size + f.size > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root else fs.LocalFileSystem()
        for path in partition.paths:
            with store.open_input_file(path) as f:
                parts, error = _parts(path, f.read())
            yield path, parts, error


class OfficeSource(DataSource):
    """`spark.read.format("office").load(path)`: one row for each file, of the schema declared here."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return f"path string, parts {PARTS}, error string"

    def reader(self, schema) -> DataSourceReader:
        return OfficeReader(self.options)


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """Each .docx and .xlsx file under a path as one row, its names and types those of DOC_RESULT.

    Columns: path, original_filename, document_type, source_type, extraction_method,
    total_pages, has_table, full_text, elements (type, text), tables, pages and error. A sheet
    is a page, with its table and that as Markdown. Blank paragraphs, rows and tables go; a file
    that can't be read has empty texts and an error. No files: no rows. The path may be local or
    of any store that Arrow opens (hdfs, s3, gs).
    """
    spark.dataSource.register(OfficeSource)
    files = spark.read.format("office").load(path)
    kind_of = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    clean = lambda x: tx.normalize_text(F.coalesce(x, F.lit("")))
    tidy = F.transform("parts", lambda p: F.struct(
        p["style"].alias("style"), p["sheet"].alias("sheet"), clean(p["text"]).alias("text"),
        without_empty_rows(F.transform(p["matrix"], lambda r: F.transform(r, clean))).alias("matrix"),
    ))
    rows = files.select("path", kind_of.alias("document_type"), "error", F.filter(tidy, lambda p: (F.size(p["matrix"]) > 0) | (p["text"] != "")).alias("parts"))
    table = lambda p: p["style"] == "table"
    body = lambda p: F.array_join(F.transform(p["matrix"], lambda r: F.array_join(r, "\t")), "\n")
    head = lambda p: F.when(p["sheet"].isNotNull(), F.concat(F.lit("=== Sheet: "), p["sheet"], F.lit(" ===\n"))).otherwise("")
    kind = lambda p: F.when(table(p), "table").when(F.rlike(p["style"], F.lit("heading|title")), "heading").when(F.contains(p["style"], F.lit("list")), "list").otherwise(tx.line_type(p["text"]))
    own = lambda p: F.struct(kind(p).alias("type"), F.when(table(p), F.concat(head(p), body(p))).otherwise(p["text"]).alias("text"))
    title = lambda p: F.struct(F.lit("heading").alias("type"), F.concat(F.lit("Sheet: "), p["sheet"]).alias("text"))
    elements = F.flatten(F.transform("parts", lambda p: F.when(p["sheet"].isNotNull(), F.array(title(p), own(p))).otherwise(F.array(own(p)))))
    sheets = F.col("document_type") == "xlsx"
    none = F.lit(None)
    tables = F.transform(F.filter("parts", table), lambda p, i: F.struct(
        F.when(sheets, i + 1).otherwise(1).alias("page"), p["sheet"].alias("sheet_name"), F.when(sheets, "xlsx_native").otherwise("docx_native").alias("detection_method"), F.get(p["matrix"], F.lit(0)).alias("headers"),
        p["matrix"].alias("matrix"), markdown_text(p["matrix"]).alias("markdown"), none.cast("double").alias("table_confidence"), none.cast(sc.VALIDATION).alias("validation"),
    ))
    said = F.filter(F.transform("parts", lambda p: own(p)["text"]), lambda x: x != "")
    out = rows.select("path", "document_type", "error", elements.alias("elements"), tables.cast(f"array<{sc.TABLE}>").alias("tables"), said.alias("_lines"))
    out = out.withColumn("full_text", tx.normalize_text(F.array_join("_lines", "\n")))
    page = lambda n, how, sheet, text, lines, parts: F.struct(n.alias("page"), F.lit(how).alias("method"), sheet.alias("sheet_name"), text.alias("text"), none.cast("double").alias("confidence"), lines.alias("lines"), none.cast("array<double>").alias("confidences"), parts.alias("elements"))
    by_sheet = F.transform("tables", lambda t: page(t["page"], "table_extraction", t["sheet_name"], t["markdown"], none.cast("array<string>"), none.cast("array<struct<type:string,text:string>>")))
    whole = F.array(page(F.lit(1), "native_text", none.cast("string"), F.col("full_text"), F.col("_lines"), F.col("elements")))
    pages = F.when(sheets, by_sheet.cast(f"array<{sc.PAGE}>")).otherwise(whole.cast(f"array<{sc.PAGE}>"))
    return out.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("original_filename"), "document_type", F.col("document_type").alias("source_type"), F.when(sheets, "table_extraction").otherwise("native_text").alias("extraction_method"),
        F.when(sheets, F.size("tables")).otherwise(1).alias("total_pages"), (F.size("tables") > 0).alias("has_table"), "full_text", "elements", "tables", pages.alias("pages"), "error",
    )
