"""Files that hold tables in a binary form: SQLite databases and XLSX workbooks.

A file is read once, by one task; its rows are written to the shared folder and numbered from there, over
all files of a folder or glob in the order of their names.
"""

from __future__ import annotations

import io
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import Decimal
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.errors import DataSourceError
from veilframe.operators.sheet import ROW
from veilframe.storage import fresh_path

BATCH_ROWS = 2000
_RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def number_text(x: float) -> str:
    """A float without exponent, whole numbers without a point."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else ("inf" if x > 0 else "-inf")
    return str(int(x)) if x == int(x) else format(Decimal(repr(x)), "f")


def cell_text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return number_text(value) if isinstance(value, float) else str(value)


def _batches(file: str, rows: Iterator[tuple[str, int, dict[str, str]]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    kind = pa.map_(pa.string(), pa.string())

    def made() -> pa.RecordBatch:
        names, numbers, values = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array(names), pa.array(numbers, pa.int64()), pa.array([list(v.items()) for v in values], kind)], ["file", "table", "at", "cells"])

    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield made()
            held = []
    if held:
        yield made()


def _sqlite_rows(data: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    if not data:
        return
    connection = sqlite3.connect(":memory:")
    connection.text_factory = lambda b: b.decode("utf-8", "replace")
    quote = lambda name: '"' + name.replace('"', '""') + '"'
    try:
        connection.deserialize(data)
        tables = [r[0] for r in connection.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        for table in tables:
            cursor = connection.execute(f"SELECT * FROM {quote(table)}")
            names = [d[0] for d in cursor.description]
            yield table, 0, dict.fromkeys(names, "")  # row 0 carries the columns of tables without rows
            for at, row in enumerate(cursor, 1):
                yield table, at, {n: cell_text(v) for n, v in zip(names, row, strict=True)}
    except sqlite3.DatabaseError as e:
        raise DataSourceError(str(e)) from None
    finally:
        connection.close()


def _contents(reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _batches(batch.column(0)[k].as_py(), reader(batch.column(1)[k].as_py()))

    return run


#: Tables of all files up to this number are broadcast with where their rows begin; more are joined by a shuffle.
BROADCAST_TABLES = 100_000


def _tables(spark: SparkSession, path: str, reader) -> tuple[DataFrame, list[str]]:
    """_row_idx, table, cells of all rows of all files; and the names of their columns in the order first seen (by file, table, place), a row a name on the driver."""
    place = fresh_path(spark, "tables")
    schema = "file string, table string, at long, cells map<string,string>"
    spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_contents(reader), schema).write.parquet(place)
    rows = spark.read.schema(schema).parquet(place)
    # row 0 of each table carries its columns
    seen = rows.filter("at = 0").select("file", "table", F.posexplode(F.map_keys("cells")).alias("place", "name")).groupBy("name").agg(F.min(F.struct("file", "table", "place")).alias("first"))
    names = [r["name"] for r in seen.orderBy("first").collect()]
    counts = rows.groupBy("file", "table").agg(F.count_if(F.col("at") > 0).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "table").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a table
    starts = counts.select("file", "table", before.alias("before"))
    few = counts.limit(BROADCAST_TABLES + 1).count() <= BROADCAST_TABLES
    numbered = rows.filter("at > 0").join(F.broadcast(starts) if few else starts, ["file", "table"])
    return numbered.select((F.col("at") + F.col("before")).alias(ROW), "table", "cells"), names


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """All tables of a database: __table, then the columns of all tables in the order first seen; missing ones and NULL are empty. Several files follow each other."""
    rows, names = _tables(spark, path, _sqlite_rows)
    if not names:
        return spark.createDataFrame([], f"{ROW} long")
    return rows.select(ROW, F.col("table").alias("__table"), *[F.coalesce(F.try_element_at("cells", F.lit(n)), F.lit("")).alias(n) for n in names])


def _column(reference: str) -> int:
    number = 0
    for c in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(c) - 64
    return number - 1


def _is_date(code: str) -> bool:
    """Whether a number format shows dates or times: it has one of their letters outside quotes, brackets and escapes."""
    return bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|general', "", code.lower())))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.parse(book.open("xl/styles.xml"))
    custom = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{_SHEET}numFmt")}
    built_in = {*map(str, range(14, 23)), *map(str, range(27, 37)), *map(str, range(45, 48)), *map(str, range(50, 59))}  # fixed values
    cells = styles.find(f"{_SHEET}cellXfs")
    numbers = [x.get("numFmtId", "0") for x in ([] if cells is None else cells)]
    return {i for i, n in enumerate(numbers) if (_is_date(custom[n]) if n in custom else n in built_in)}


def date_text(serial: float, from_1904: bool = False) -> str:
    """ISO text of a day number: a date, with the time if it isn't midnight; under one day the time alone."""
    seconds = round(serial * 86400)
    moment = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30 if seconds >= 60 * 86400 else 31)  # day 60 never was
    moment += timedelta(seconds=seconds)
    if 0 <= seconds < 86400:
        return moment.strftime("%H:%M:%S")
    return moment.strftime("%Y-%m-%dT%H:%M:%S" if seconds % 86400 else "%Y-%m-%d")


def _xlsx_value(cell: ElementTree.Element, shared: list[str], dates: set[int], from_1904: bool) -> str:
    kind, value = cell.get("t", "n"), cell.findtext(f"{_SHEET}v") or ""
    if kind == "s":
        return shared[int(value)] if value else ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "n" and value and int(cell.get("s", "0")) in dates:
        return date_text(float(value), from_1904)
    if kind == "n" and value:
        return number_text(float(value)) if re.search("[.eE]", value) else value
    return value


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The part of the workbook's first sheet, in the workbook's own order, and whether days count from 1904."""
    if "xl/workbook.xml" not in book.namelist():  # not whole, but the sheets can be read by number
        return min((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])), False
    workbook = ElementTree.parse(book.open("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).iter(f"{_RELATION}Relationship")}
    first = next(workbook.iter(f"{_SHEET}sheet"), None)
    if first is None:
        raise DataSourceError("not a readable workbook: no sheets")
    target = targets[first.get(f"{_OFFICE}id")]
    properties = workbook.find(f"{_SHEET}workbookPr")
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", properties is not None and properties.get("date1904") in ("1", "true")


def _xlsx_rows(data: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        part, from_1904 = _first_sheet(book)
        shared, dates = [], _date_styles(book)
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in ElementTree.parse(book.open("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        names: dict[int, str] = {}
        last: dict[str, int] = {}  # of columns with one name the last holds
        for at, (_, row) in enumerate(e for e in ElementTree.iterparse(book.open(part)) if e[1].tag == f"{_SHEET}row"):
            values = {_column(c.get("r")) if c.get("r") else i: _xlsx_value(c, shared, dates, from_1904) for i, c in enumerate(row.iter(f"{_SHEET}c"))}
            if at == 0:
                names = dict(sorted(values.items()))
                last = {name: i for i, name in names.items()}
                yield "sheet", 0, dict.fromkeys(names.values(), "")
            else:
                yield "sheet", at, {names[i]: v for i, v in values.items() if i in names and last[names[i]] == i}
            row.clear()
    except (zipfile.BadZipFile, ElementTree.ParseError, IndexError, KeyError, ValueError) as e:
        raise DataSourceError(f"not a readable workbook: {e}") from None


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first worksheet: its first row has the headers; empty cells are null. Dates are ISO text. Rows of several files follow each other, their columns united by name."""
    rows, names = _tables(spark, path, _xlsx_rows)
    if not names:
        return spark.createDataFrame([], f"{ROW} long")
    return rows.select(ROW, *[F.nullif(F.try_element_at("cells", F.lit(n)), F.lit("")).alias(n) for n in names])
