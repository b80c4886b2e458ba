"""Exports: CSV, JSON, JSON lines, and text by template. Each is a DataFrame of lines in row order, written as text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.errors import InvalidInput
from veilframe.operators.sheet import ROW, headers

SEPARATORS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}
BOM = "﻿"


def _value(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def separator(name: str, custom: str = "") -> str:
    if name == "custom":
        return custom or "\t"
    if name not in SEPARATORS:
        raise InvalidInput(f"unknown separator {name!r}")
    return SEPARATORS[name]


def _quoted(text: Column, sep: str) -> Column:
    special = text.contains('"') | text.contains("\n") | text.contains("\r") | text.contains(sep)
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(sheet: DataFrame, columns: Sequence[str] | None = None, sep: str = ",", header: bool = True, bom: bool = True) -> DataFrame:
    """_row_idx, line; the header is row 0 and bears the byte order mark."""
    names = list(columns or headers(sheet))
    rows = sheet.select(ROW, F.concat_ws(sep, *[_quoted(_value(n), sep) for n in names]).alias("line"))
    if not header:
        return rows
    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias(ROW), F.concat_ws(sep, *[_quoted(F.lit(n), sep) for n in names]).alias("line"))
    return head.withColumn("line", F.concat(F.lit(BOM if bom else ""), "line")).unionByName(rows)


def _json_string(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substr(whole, F.lit(6), F.char_length(whole) - 6)


def json_objects(sheet: DataFrame, columns: Sequence[str] | None = None, indent: int = 0) -> DataFrame:
    """_row_idx, line: one object a row, all values strings, null as "". With indent an object takes several lines."""
    names = list(columns or headers(sheet))
    pad, end = ("\n" + " " * 2 * indent, "\n" + " " * indent) if indent else ("", "")
    gap = ": " if indent else ":"
    pairs = F.concat_ws(",", *[F.concat(F.lit(pad), _json_string(F.lit(n)), F.lit(gap), _json_string(_value(n))) for n in names])
    return sheet.select(ROW, F.concat(F.lit(" " * indent + "{"), pairs, F.lit(end + "}")).alias("line"))


def json_array_lines(sheet: DataFrame, columns: Sequence[str] | None = None, indent: int = 2) -> DataFrame:
    """_row_idx, line of one JSON array over all rows."""
    last = sheet.agg(F.max(ROW)).first()[0]
    rows = json_objects(sheet, columns, indent).withColumn("line", F.when(F.col(ROW) < F.lit(last), F.concat("line", F.lit(","))).otherwise(F.col("line"))) if last is not None else json_objects(sheet, columns, indent)
    ends = sheet.sparkSession.createDataFrame([(0, "["), (2**62, "]")], f"{ROW} long, line string")
    return rows.unionByName(ends)


_COLUMN_PLACES = ("{字段名}", "{name}", "{值}", "{value}")


def template_mode(template: str, mode: str | None = None) -> str:
    """percol or merge: as given, else by the placeholders."""
    return mode or ("percol" if any(p in template for p in _COLUMN_PLACES) else "merge")


def text_lines(sheet: DataFrame, template: str, columns: Sequence[str] | None = None, mode: str | None = None) -> DataFrame:
    """_row_idx, at, line. percol: a line for each selected column of a row, from its name and value. merge: a line a row, {column} of any column, unknown ones empty."""
    names = headers(sheet)
    if template_mode(template, mode) == "percol":
        made = []
        for i, n in enumerate(columns or names):
            parts = re.split("(" + "|".join(map(re.escape, _COLUMN_PLACES)) + ")", template)
            own = [F.lit(n) if p in _COLUMN_PLACES[:2] else _value(n) if p in _COLUMN_PLACES[2:] else F.lit(p) for p in parts]
            made.append(F.struct(F.lit(i).alias("at"), F.concat(*own).alias("line")))
        return sheet.select(ROW, F.explode(F.array(*made)).alias("x")).select(ROW, "x.at", "x.line")
    parts = re.split(r"\{([^{}]*)\}", template)
    own = [F.lit(p) if i % 2 == 0 else _value(p) if p in names else F.lit("") for i, p in enumerate(parts)]
    return sheet.select(ROW, F.lit(0).alias("at"), F.concat(*own).alias("line"))


def write_lines(lines: DataFrame, path: str, eol: str = "\r\n", single_file: bool = False) -> None:
    """Writes lines in order, as part files that follow each other; single_file gathers them in one task, for small sheets."""
    order = [c for c in (ROW, "at") if c in lines.columns]
    ordered = lines.repartition(1).sortWithinPartitions(*order) if single_file else lines.orderBy(*order)
    ordered.select("line").write.option("lineSep", eol).text(path)
