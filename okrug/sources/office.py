"""Workbooks, text documents and archives: zipped XML is read by the standard library, file by file on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHEET = "path string, sheet string, row int, cells array<string>"
TABLE = "path string, table_no int, heading string, row int, cells array<string>"
MEMBER = "path string, member string, content binary"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def _column(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of each non-empty row of a workbook, all cells as texts, empty ones null; rows stream, only the table of shared texts is held."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_texts(x) for x in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()]
        links = {x.get("Id"): x.get("Target") for x in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        for sheet in (x for x in ElementTree.parse(z.open("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"):
            target = next(links[v] for k, v in sheet.attrib.items() if _local(k) == "id")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            number = 0
            for _, row in ElementTree.iterparse(z.open(path)):
                if _local(row.tag) != "row":
                    continue
                number = int(row.get("r") or number + 1)
                cells: list[str | None] = []
                for c in row:
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = c.get("t"), next((x.text for x in c if _local(x.tag) == "v"), None)
                    text = _texts(c) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value
                    cells[at] = text if text != "" else None
                row.clear()
                if any(x is not None for x in cells):
                    yield sheet.get("name"), number, cells


def document_tables(content: bytes) -> Iterator[tuple[int, str | None, int, list[str]]]:
    """(table, heading, row, cells) of a text document: each row of its tables, from 1, with the last non-blank paragraph before the table."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.parse(z.open("word/document.xml")).getroot()[0]
    heading, table = None, 0
    for block in body:
        if _local(block.tag) == "p" and (text := _texts(block).strip()):
            heading = text
        elif _local(block.tag) == "tbl":
            table += 1
            for row, tr in enumerate((x for x in block if _local(x.tag) == "tr"), 1):
                yield table, heading, row, [_texts(c).strip() for c in tr if _local(c.tag) == "tc"]


def archive_members(content: bytes, pattern: str) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for member in z.infolist():
            if not member.is_dir() and re.search(pattern, member.filename):
                yield member.filename, z.read(member)


def _each_file(spark: SparkSession, paths: str | list[str], schema: str, read: Callable[[bytes], Iterator[tuple]], glob: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for row in read(content):
                    rows.append((path, *row))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    return files.select("path", "content").mapInPandas(run, schema)


def read_workbooks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, sheet, row, cells) of all rows of all sheets, cells as texts."""
    return _each_file(spark, paths, SHEET, workbook_rows, "*.xlsx")


def read_document_tables(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, table_no, heading, row, cells) of all tables of text documents."""
    return _each_file(spark, paths, TABLE, document_tables, "*.docx")


def read_archives(spark: SparkSession, paths: str | list[str], pattern: str = "") -> DataFrame:
    """(path, member, content) of the members of archives whose names match; one member is held at a time."""
    return _each_file(spark, paths, MEMBER, lambda content: archive_members(content, pattern), "*.zip")


def sliced(rows: DataFrame, first: int, last: int, columns: dict[str, int]) -> DataFrame:
    """Rows `first` to `last` of each sheet, with the cells at fixed places (from 0) as named columns."""
    return rows.where(F.col("row").between(first, last)).select("path", "sheet", "row", *[F.get("cells", F.lit(at)).alias(name) for name, at in columns.items()])


def below_header(rows: DataFrame, columns: dict[str, str], offset: int = 0, by: tuple[str, ...] = ("path", "sheet")) -> DataFrame:
    """The rows below the first row that holds all of the titles in `columns` (name: title), with the cells under these titles, `offset` places further right.

    A group of `by` without such a row has no rows. Titles are compared without outer blanks.
    """
    keys = Window.partitionBy(*by).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    trimmed = F.transform("cells", lambda c: F.trim(c))
    is_header = F.coalesce(F.array_size(F.array_intersect(trimmed, F.array(*[F.lit(t) for t in columns.values()]))) == len(set(columns.values())), F.lit(False))
    titled = rows.withColumn("__titles", F.first(F.when(is_header, trimmed), ignorenulls=True).over(keys))
    place = lambda title: F.array_position("__titles", F.lit(title)).cast("int") - 1 + offset
    return titled.where(F.col("__titles").isNotNull()).select(*by, "row", *[F.get("cells", place(title)).alias(name) for name, title in columns.items()])


def write_workbook(sheets: dict[str, list[list]], path: str) -> None:
    """A plain workbook of a few small sheets, all cells as texts; null cells are left out."""
    escape = lambda x: str(x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    letters = lambda k: (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)
    ns = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{ns}/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{i}">' + "".join(f'<c r="{letters(j)}{i}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for j, v in enumerate(row) if v is not None) + "</row>" for i, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
