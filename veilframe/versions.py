"""Sheets in versions that share what they have in common, and the log that holds their order.

A sheet's state says where its cells are: pieces of whole rows, in ranges of row numbers; columns
written anew since; cells edited since. A change writes a column or some cells and a new state,
undoing one writes a state only. States, sessions and operations are entries of one log; an entry's
number can be taken once, so that two sessions on one folder can't overwrite each other's changes.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilframe.errors import InvalidInput
from veilframe.operators.sheet import ROW, headers

RANGE = "_range"
#: Rows whose numbers share a folder of a piece; compaction writes those ranges again that have edits.
RANGE_ROWS = 1_000_000
#: Edited cells up to this number are broadcast when they are read; more are joined by a shuffle.
BROADCAST_CELLS = 500_000

State = dict[str, Any]


class Taken(Exception):
    """Another session has written the entry of this number."""


class Log:
    """Entries 1, 2, ... as JSON files in a folder, each written once and whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root}/log"
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()

    def read(self, after: int) -> list[dict[str, Any]]:
        """All entries behind a number, in order. A row an entry reaches the driver."""
        place = self._place(self.root)
        if not place.getFileSystem(self._conf).exists(place):
            return []
        rows = self.spark.read.schema("value string").text(self.root, wholetext=True, pathGlobFilter="[0-9]*.json").filter(F.regexp_extract(F.col("_metadata.file_name"), r"\d+", 0).cast("long") > after)
        return sorted((json.loads(r["value"]) for r in rows.collect()), key=lambda e: e["number"])

    def write(self, number: int, entry: dict[str, Any]) -> None:
        """Raises Taken if the number has an entry: the file is written under another name and then given its own, which fails if that is there."""
        own, final = self._place(f"{self.root}/.{uuid.uuid4().hex}"), self._place(f"{self.root}/{number:012d}.json")
        fs = own.getFileSystem(self._conf)
        own, final = fs.makeQualified(own), fs.makeQualified(final)
        out = fs.create(own, False)
        out.write(bytearray(json.dumps({**entry, "number": number}, ensure_ascii=False).encode()))
        out.close()
        try:
            if urlparse(own.toString()).scheme == "file":  # there only a link is atomic
                os.link(own.toUri().getPath(), final.toUri().getPath())
            else:
                jvm = self.spark._jvm
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self._conf).rename(own, final, options)
        except Exception as e:
            if fs.exists(final):
                raise Taken(str(number)) from e
            raise
        finally:
            fs.delete(own, False)


def _named(columns: Sequence[str]) -> list:
    return [F.col(f"`{c}`") for c in columns]


class Store:
    """Reads and writes the states of sheets below a folder. Files are never changed once written."""

    def __init__(self, spark: SparkSession, root: str, range_rows: int = RANGE_ROWS):
        self.spark, self.root, self.range_rows = spark, root, range_rows

    def _fresh(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def _write_rows(self, df: DataFrame) -> tuple[str, int, bool]:
        """Whole rows by ranges of their numbers, columns under names of their own; path, number of rows, and whether these are numbered 1, 2, ... to it."""
        path, seen, names = self._fresh(), Observation(), headers(df)
        plain = df.select(ROW, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
        ranges = F.floor((F.col(ROW) - 1) / self.range_rows).cast("long")
        plain.withColumn(RANGE, ranges).observe(seen, F.count(F.lit(1)).alias("n"), F.min(ROW).alias("low"), F.max(ROW).alias("high")).write.partitionBy(RANGE).parquet(path)
        found = seen.get
        return path, found["n"], found["n"] == 0 or (found["low"] == 1 and found["high"] == found["n"])

    def create(self, df: DataFrame) -> State:
        path, rows, dense = self._write_rows(df)
        types = {f.name: f.dataType.simpleString() for f in df.schema}
        names = headers(df)
        return {"rows": rows, "dense": dense, "pieces": [{"path": path, "ranges": None, "without": []}], "added": [], "columns": {c: {"part": None, "at": f"c{i}", "type": types[c], "cells": []} for i, c in enumerate(names)}}

    def read(self, state: State, columns: Sequence[str] | None = None) -> DataFrame:
        """The sheet, or some of its columns; only what these are in is read.

        Without changes this is a scan. Columns written anew are joined by row number, edited cells too,
        those of a cell edited several times by the last edit; they are broadcast if they are few.
        """
        wanted = list(state["columns"]) if columns is None else list(columns)
        own = {c: state["columns"][c] for c in wanted}
        number = {c: f"c{list(state['columns']).index(c)}" for c in wanted}  # what a column is called on the way, whatever its name
        base = [c for c in wanted if own[c]["part"] is None]
        schema = f"{ROW} long, " + "".join(f"{own[c]['at']} {own[c]['type']}, " for c in base) + f"{RANGE} long"
        pieces = []
        for p in state["pieces"]:
            piece = self.spark.read.schema(schema).parquet(p["path"])
            if p["ranges"] is not None:
                piece = piece.filter(F.col(RANGE).isin(p["ranges"]))
            if p["without"]:
                piece = piece.filter(~F.col(RANGE).isin(p["without"]))
            pieces.append(piece.select(ROW, *[F.col(own[c]["at"]).alias(number[c]) for c in base]))
        sheet = reduce(DataFrame.unionByName, pieces)
        for path in state["added"]:
            sheet = sheet.unionByName(self.spark.read.schema(f"{ROW} long").parquet(path), allowMissingColumns=True)
        parts: dict[str, list[str]] = {}
        for c in wanted:
            if own[c]["part"] is not None:
                parts.setdefault(own[c]["part"], []).append(c)
        for path, names in parts.items():
            part = self.spark.read.schema(f"{ROW} long, " + ", ".join(f"{own[c]['at']} {own[c]['type']}" for c in names)).parquet(path)
            sheet = sheet.join(part.select(ROW, *[F.col(own[c]["at"]).alias(number[c]) for c in names]), ROW, "left")
        edited = [c for c in wanted if own[c]["cells"]]
        if edited:
            sheet = sheet.join(self._edits({number[c]: own[c] for c in edited}), ROW, "left")
            sheet = sheet.withColumns({number[c]: F.when(F.col(f"e_{number[c]}").isNotNull(), F.col(f"e_{number[c]}.value").cast(own[c]["type"])).otherwise(F.col(number[c])) for c in edited})
        return sheet.select(ROW, *[F.col(number[c]).alias(c) for c in wanted])

    def _edits(self, columns: dict[str, dict[str, Any]]) -> DataFrame:
        """One row a row number: e_<name> struct<value> of each column, null where it has no edit; the last edit of a cell holds."""
        layers = {e["path"]: e for own in columns.values() for e in own["cells"]}
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(f"{ROW} long, cell string, value string").parquet(path).withColumn("_order", F.lit(e["number"])) for path, e in layers.items()])
        held = {name: [e["number"] for e in own["cells"]] for name, own in columns.items()}
        last = [F.max_by(F.struct("value"), F.when((F.col("cell") == columns[name]["id"]) & F.col("_order").isin(held[name]), F.col("_order"))).alias(f"e_{name}") for name in columns]
        wide = rows.groupBy(ROW).agg(*last)
        return F.broadcast(wide) if sum(e["cells"] for e in layers.values()) <= BROADCAST_CELLS else wide

    def with_columns(self, state: State, df: DataFrame, columns: Sequence[str], counts: Sequence) -> tuple[State, dict[str, int]]:
        """The state with columns as df has them (by row number); counts are aggregates of df, made in the same pass."""
        path, seen = self._fresh(), Observation()
        types = {f.name: f.dataType.simpleString() for f in df.schema}
        df.observe(seen, F.count(F.lit(1)).alias("_rows"), *counts).select(ROW, *[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(columns)]).write.parquet(path)
        changed = {c: {"part": path, "at": f"p{i}", "type": types[c], "cells": []} for i, c in enumerate(columns)}
        return {**state, "columns": {c: changed.get(c, own) for c, own in state["columns"].items()}}, {k: v or 0 for k, v in seen.get.items()}

    def with_cells(self, state: State, edits: DataFrame) -> tuple[State, dict[str, int]]:
        """The state with cells edited. edits: _row_idx, column, value and, if cells occur more than once, _at, of which the greatest holds.

        Rows that the sheet doesn't have are added. Only the edits are written, in the pass that checks their rows and columns.
        """
        names = list(state["columns"])
        ordered = "_at" in edits.columns
        flat = edits.select(F.col(ROW).cast("long").alias(ROW), F.col("column").cast("string").alias("column"), F.col("value").cast("string").alias("value"), (F.col("_at") if ordered else F.lit(0)).alias("_at"))
        last = flat.groupBy(ROW, "column").agg(F.max_by(F.struct("value"), "_at")["value"].alias("value"), F.count(F.lit(1)).alias("times"), F.count_distinct("_at").alias("kinds"))
        path, seen = self._fresh(), Observation()
        known = F.col("column").isin(names)
        unclear = F.col("times") > F.col("kinds")
        last.observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.when(~F.coalesce(known, F.lit(False)), F.coalesce("column", F.lit("null")))).alias("unknown"), F.max(unclear).alias("unclear"), F.min(F.coalesce(ROW, F.lit(0))).alias("low"), F.max(ROW).alias("high"), F.collect_set(F.when(known, F.col("column"))).alias("touched")).select(
            ROW, F.col("column").alias("cell"), "value"
        ).write.parquet(path)
        found = seen.get
        if not found["n"]:
            return state, {"written": 0, "added": 0}
        if found["unknown"] is not None:
            raise InvalidInput(f"列 `{found['unknown']}` 不存在")
        if found["unclear"]:
            raise InvalidInput("a cell occurs more than once with nothing to order it by")
        if found["low"] < 1:
            raise InvalidInput("row numbers begin at 1")
        added = 0
        new = self._fresh()
        if not state["dense"] or state["added"] or found["high"] > state["rows"]:  # else all rows 1 to rows are there
            counted = Observation()
            own = self.spark.read.schema(f"{ROW} long").parquet(path).distinct()
            own.join(self.read(state, []), ROW, "left_anti").observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(new)
            added = counted.get["n"]
        entry = {"path": path, "cells": found["n"], "number": max([time.time_ns(), *(e["number"] + 1 for own in state["columns"].values() for e in own["cells"])])}
        columns = {c: {**own, "id": c, "cells": [*own["cells"], entry]} if c in found["touched"] else own for c, own in state["columns"].items()}
        return {**state, "rows": state["rows"] + added, "added": [*state["added"], *([new] if added else [])], "columns": columns}, {"written": found["n"], "added": added}

    def compacted(self, state: State) -> State:
        """The same cells with no edits left: row ranges that have edits are written again, others stay where they are. Columns written anew are in all ranges."""
        edits = [e for own in state["columns"].values() for e in own["cells"]]
        moved = any(own["part"] is not None for own in state["columns"].values())
        if not edits and not moved and not state["added"]:
            return state
        if moved:
            return self.create(self.read(state))
        of = lambda df: df.select(F.floor((F.col(ROW) - 1) / self.range_rows).cast("long").alias(RANGE)).distinct()
        rows = [self.spark.read.schema(f"{ROW} long").parquet(p) for p in dict.fromkeys([*(e["path"] for e in edits), *state["added"]])]
        touched = sorted(r[RANGE] for r in of(reduce(DataFrame.unionByName, rows)).collect())  # a row a range
        sheet = self.read(state)
        path, *_ = self._write_rows(sheet.filter(F.floor((F.col(ROW) - 1) / self.range_rows).cast("long").isin(touched)))
        kept = [{**p, "without": sorted({*p["without"], *touched})} for p in state["pieces"]]
        kept = [p for p in kept if p["ranges"] is None or set(p["ranges"]) - set(p["without"])]
        columns = {c: {"part": None, "at": f"c{i}", "type": own["type"], "cells": []} for i, (c, own) in enumerate(state["columns"].items())}
        return {"rows": state["rows"], "dense": state["dense"] and not state["added"], "pieces": [*kept, {"path": path, "ranges": touched, "without": []}], "added": [], "columns": columns}
