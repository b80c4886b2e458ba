"""CSV, JSON, JSON lines and plain text."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veilframe.errors import DataSourceError, InvalidInput
from veilframe.operators.columns import json_headers, json_objects
from veilframe.operators.sheet import ROW, number_rows
from veilframe.sources.records import INSIDE, OUTSIDE, csv_records, json_elements, quote_states
from veilframe.storage import written

#: Bytes of a chunk that a text without line breaks is cut into.
CHUNK_BYTES = 4096


def require_utf8(spark: SparkSession, path: str, sep: str = "\n") -> None:
    """Raises for files that aren't UTF-8; the strict formats ask for it with one narrow pass. sep: any ASCII character, where the files are cut for it."""
    if not spark.read.option("lineSep", sep).text(path).filter(~F.is_valid_utf8("value")).isEmpty():
        raise DataSourceError(f"{path} isn't valid UTF-8")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """_row_idx, value of each line; invalid bytes as U+FFFD, a carriage return before the line feed is dropped."""
    text = spark.read.option("lineSep", "\n").text(path)
    return number_rows(text).withColumn("value", F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", ""))


def _probe_csv(spark: SparkSession, path: str, sep: str) -> tuple[bool, bool]:
    """Whether a file isn't UTF-8, and whether a record goes over several lines: if none does, each line begins outside quotes, so one that then ends inside them tells."""
    text = spark.read.option("lineSep", "\n").text(path)
    broken = bool(text.agg(F.max(~F.is_valid_utf8("value"))).first()[0])
    after = quote_states(sep)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = any(after(line, OUTSIDE) == INSIDE for line in batch.column(0).to_pylist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([True])], ["found"])
                return

    quoted = text.filter(F.col("value").contains('"')).select(F.make_valid_utf8("value").alias("value"))
    return broken, not quoted.mapInArrow(opened, "found boolean").isEmpty()


def _number_parts(rows: DataFrame, *order: str) -> DataFrame:
    """Rows numbered 1, 2, ... in the order of columns: by ranges of them, each sorted on its own."""
    return number_rows(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order), in_files=False)


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None, strict_utf8: bool = True) -> DataFrame:
    """First record: headers. Short records are filled with null, further cells dropped, "" is null, nothing is typed.

    Of columns with the same header the last one stays. Files are split among tasks, also where records go
    over several lines (see records.py). multi_line says whether any does, if it is known.
    """
    broken, open_quotes = _probe_csv(spark, path, sep) if strict_utf8 or multi_line is None else (False, False)
    if strict_utf8 and broken:
        raise DataSourceError(f"{path} isn't valid UTF-8")
    options = {"sep": sep, "quote": '"', "escape": '"'}
    records = None
    if open_quotes if multi_line is None else multi_line:
        records = csv_records(spark, path, sep).withColumn("value", F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", ""))
        top = records.filter("number = 1").orderBy("file").first()
        first = None if top is None else next(csv.reader(io.StringIO(top["value"]), delimiter=sep), [])
    else:
        first = spark.read.csv(path, header=False, inferSchema=False, **options).first() if not spark.read.text(path).isEmpty() else None
    if first is None:
        return spark.createDataFrame([], f"{ROW} long")
    names = ["" if v is None else v for v in first]
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    if records is None:
        rows = number_rows(spark.read.csv(path, schema=schema, header=True, enforceSchema=True, **options))
    else:
        own = F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
        rows = _number_parts(records.filter("number > 1").select("file", "number", own.alias("cells")), "file", "number").select(ROW, "cells.*")
    last = {n: i for i, n in enumerate(names)}
    return rows.select(ROW, *[F.nullif(F.col(f"c{i}"), F.lit("")).alias(n) for n, i in last.items()])


#: Rows whose value isn't blank.
_FILLED = r"value rlike '\\S'"


def _first_sign(spark: SparkSession, path: str) -> str:
    """The first character that isn't white space, of files cut at closing braces: a line may be as long as its file. Empty where there is none, or a closing brace comes first."""
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    start = pieces.filter(_FILLED).select(F.regexp_extract("value", r"\S", 0).alias("sign"), "file").first()
    if start is None or pieces.filter(F.col("file") == start["file"]).select(~F.col("value").rlike(r"\S")).first()[0]:
        return ""
    return start["sign"]


def read_json(spark: SparkSession, path: str, strict_utf8: bool = True) -> DataFrame:
    """An array of objects, one object, or an object a line. Headers: all keys, in the order first seen.

    Elements of an array that aren't objects are left out; a line that isn't an object is an error.
    Other documents give an empty sheet. Missing keys and JSON null are null.
    """
    if strict_utf8:
        require_utf8(spark, path, "}")
    first = _first_sign(spark, path)
    if first == "[":
        elements = written(json_elements(spark, path), "elements")  # looked at, then read
        wrong = F.coalesce(F.json_array_length(F.concat(F.lit("["), F.col("value"), F.lit("]"))), F.lit(0)) != 1
        if not elements.filter(wrong).isEmpty():
            raise InvalidInput(f"{path} isn't a JSON array")
        items = elements.select("file", "number", json_objects(F.col("value")).alias("object")).filter("object is not null")
        items = _number_parts(items, "file", "number")
    elif first == "{":
        single = spark.read.text(path).filter(_FILLED).select(json_objects(F.col("value")).isNotNull()).first()[0]
        source = lines(spark, path).filter(_FILLED) if single else number_rows(spark.read.text(path, wholetext=True))
        items = source.select(ROW, json_objects(F.col("value")).alias("object"))
        bad = items.filter("object is null").first()
        if bad is not None:  # by number of the line, or of the file
            raise InvalidInput(f"{path}: row {bad[ROW]} isn't a JSON object")
        if single:  # numbered anew without blank lines, by places in files: partitions don't follow each other as files do
            filled = number_rows(spark.read.option("lineSep", "\n").text(path).filter(_FILLED))
            items = filled.select(ROW, json_objects(F.make_valid_utf8("value")).alias("object"))
    else:
        return spark.createDataFrame([], f"{ROW} long")
    names = json_headers(items)
    return items.select(ROW, *[F.nullif(F.try_element_at("object", F.lit(n)), F.lit("")).alias(n) for n in names])


def chunks(text: str, size: int = CHUNK_BYTES) -> Iterator[str]:
    """Parts of `size` UTF-8 bytes at most, cut between characters."""
    data, at = text.encode(), 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end].decode()
        at = end


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            parts = list(chunks(text))
            yield pa.RecordBatch.from_arrays([pa.array(range(1, len(parts) + 1), pa.int64()), pa.array(parts, pa.string())], [ROW, "content"])


def is_single_line(spark: SparkSession, path: str) -> bool:
    return spark.read.option("lineSep", "\n").text(path).limit(2).count() <= 1


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """One column, content: a row a line (blank ones too); a text of one line is cut into chunks of CHUNK_BYTES."""
    if not is_single_line(spark, path):
        return lines(spark, path).withColumnRenamed("value", "content")
    text = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", ""))
    return number_rows(text.mapInArrow(_chunked, f"{ROW} long, content string").select("content"), in_files=False)
