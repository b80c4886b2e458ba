"""A workbench: sessions of imported files, versioned sheets, operations that can be undone and redone.

A version of a sheet is a state (see versions.py) that shares with others what they have in common:
an operation writes the columns or cells that it changes, undoing it writes none. Sessions, sheets
and operations are entries of one log in the workbench's folder.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import sources
from veilframe.errors import Conflict, InvalidInput, ProcessorError
from veilframe.functions import transforms, validators
from veilframe.functions.masking import mask, validate_then_mask
from veilframe.operators import columns, extract, search, validate
from veilframe.operators import sheet as sheets
from veilframe.operators.sheet import ROW, headers, number_rows
from veilframe.plans.rules import Rule, RuleStore, template_from
from veilframe.versions import RANGE_ROWS, Log, State, Store, Taken

UNDOABLE = ("mask", "replace", "replace_all", "base64", "hash", "transform", "edit")
UNDO_LIST = 50


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


class Workbench:
    """Opens or starts the workbench in a folder. Several may be open on one folder: of two that change the same sheet the later gets Conflict, and sees the other's change from then on."""

    def __init__(self, spark: SparkSession, root: str, rules: RuleStore | None = None, range_rows: int = RANGE_ROWS):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), rules or RuleStore()
        self.log, self.store = Log(spark, self.root), Store(spark, self.root, range_rows)
        self.sessions: dict[int, dict[str, Any]] = {}
        self.sheets: dict[int, dict[str, Any]] = {}
        self.operations: dict[int, dict[str, Any]] = {}
        self._states: dict[tuple[int, int], State] = {}
        self._number = 0
        self.refresh()

    # the log

    def refresh(self) -> list[dict[str, Any]]:
        """Takes in what other sessions have written, and returns these entries."""
        new = self.log.read(self._number)
        for entry in new:
            self._apply(entry)
        return new

    def _apply(self, entry: dict[str, Any]) -> None:
        self._number = entry["number"]
        for kind, row in entry["rows"]:
            if kind == "states":
                self._states[row["sheet_id"], row["version"]] = row["state"]
            else:
                getattr(self, kind)[row["id"]] = row

    def _commit(self, rows: Callable[[], list[tuple[str, dict[str, Any]]]], sheet_id: int | None = None) -> None:
        """Writes an entry of rows (made anew if another session takes its number); Conflict if that session has changed the sheet."""
        while True:
            entry = {"rows": rows(), "at": _now()}
            try:
                self.log.write(self._number + 1, entry)
            except Taken:
                new = self.refresh()
                if any(kind == "states" and row["sheet_id"] == sheet_id for e in new for kind, row in e["rows"]):
                    raise Conflict(f"sheet {sheet_id} has been changed by another session") from None
                continue
            self._apply({**entry, "number": self._number + 1})
            return

    def _operation(self, sheet_id: int, kind: str, params: dict[str, Any], touched: Sequence[str] = (), before: int | None = None, after: int | None = None, affected: int = 0) -> dict[str, Any]:
        return {"id": len(self.operations) + 1, "sheet_id": sheet_id, "kind": kind, "params_json": json.dumps(params, ensure_ascii=False), "columns": list(touched), "before_version": before, "after_version": after, "affected": affected, "undone": False, "created_at": _now()}

    def _log(self, sheet_id: int, kind: str, params: dict[str, Any]) -> None:
        self._commit(lambda: [("operations", self._operation(sheet_id, kind, params))])

    # sheets

    def state(self, sheet_id: int, version: int | None = None) -> State:
        if sheet_id not in self.sheets:
            raise ProcessorError(f"no sheet {sheet_id}")
        return self._states[sheet_id, self.sheets[sheet_id]["version"] if version is None else version]

    def data(self, sheet_id: int, version: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """A sheet, or some of its columns: only files that hold these are read."""
        return self.store.read(self.state(sheet_id, version), columns)

    def add_sheet(self, session_id: int, name: str, df: DataFrame) -> int:
        state, made = self.store.create(df), []

        def rows() -> list[tuple[str, dict[str, Any]]]:
            number = len(self.sheets) + 1
            made[:] = [number]
            position = sum(s["session_id"] == session_id for s in self.sheets.values())
            return [("sheets", {"id": number, "session_id": session_id, "name": name, "position": position, "headers": headers(df), "version": 0}), ("states", {"sheet_id": number, "version": 0, "state": state})]

        self._commit(rows)
        return made[0]

    def _change(self, sheet_id: int, state: State, operation: Callable[[int, int], dict[str, Any]], others: Sequence[dict[str, Any]] = ()) -> None:
        """One entry: the sheet's new state, the operation that made it (given the versions before and after), and changes of other operations."""

        def rows() -> list[tuple[str, dict[str, Any]]]:
            own = self.sheets[sheet_id]
            after = 1 + max(v for s, v in self._states if s == sheet_id)
            return [("states", {"sheet_id": sheet_id, "version": after, "state": state}), ("sheets", {**own, "version": after}), ("operations", operation(own["version"], after)), *[("operations", o) for o in others]]

        self._commit(rows, sheet_id)

    def import_file(self, path: str, **options) -> dict[str, Any]:
        """Reads a file into a new session with one sheet."""
        kind = options.pop("format", None) or sources.detect(path)
        df = sources.load(self.spark, path, kind, **options)
        state, made = self.store.create(df), []
        name = path.rstrip("/").split("/")[-1]

        def rows() -> list[tuple[str, dict[str, Any]]]:
            session, number = len(self.sessions) + 1, len(self.sheets) + 1
            made[:] = [session, number]
            return [
                ("sessions", {"id": session, "name": name, "source_path": path, "source_type": kind, "row_count": state["rows"], "created_at": _now()}),
                ("sheets", {"id": number, "session_id": session, "name": name, "position": 0, "headers": headers(df), "version": 0}),
                ("states", {"sheet_id": number, "version": 0, "state": state}),
                ("operations", self._operation(number, "import", {"path": path, "rows": state["rows"]})),
            ]

        self._commit(rows)
        return {"session_id": made[0], "sheet_id": made[1], "row_count": state["rows"], "headers": headers(df)}

    def list_sessions(self) -> list[dict[str, Any]]:
        return sorted(self.sessions.values(), key=lambda s: (s["created_at"], s["id"]), reverse=True)

    def list_sheets(self, session_id: int) -> list[dict[str, Any]]:
        return sorted((s for s in self.sheets.values() if s["session_id"] == session_id), key=lambda s: s["position"])

    def rename_sheet(self, sheet_id: int, name: str) -> None:
        self.state(sheet_id)
        self._commit(lambda: [("sheets", {**self.sheets[sheet_id], "name": name})])

    def page(self, sheet_id: int, number: int = 1, size: int = 50) -> dict[str, Any]:
        """Rows of a page; their number is known without a scan."""
        return {"headers": self.sheets[sheet_id]["headers"], "rows": [r.asDict() for r in sheets.page(self.data(sheet_id), number, size).collect()], "total": self.state(sheet_id)["rows"], "page": max(number, 1), "page_size": size}

    # operations in place

    def _rewrite(self, sheet_id: int, made: DataFrame, touched: Sequence[str], counts: Sequence[Column], kind: str, params: dict[str, Any], affected: Callable[[dict[str, int]], int]) -> dict[str, int]:
        """Writes columns anew and the operation that did so; counts (aggregates of made) come from the same pass."""
        state, found = self.store.with_columns(self.state(sheet_id), made, touched, counts)
        self._change(sheet_id, state, lambda before, after: self._operation(sheet_id, kind, params, touched, before, after, affected(found)))
        return found

    def _transform(self, sheet_id: int, column: str, kind: str, params: dict[str, Any], function: Callable[[Column], Column]) -> dict[str, int]:
        source = self.data(sheet_id)
        columns.check_column(source, column)
        old, new = F.col(f"`{column}`"), F.col(f"`{column} made`")
        both = self.data(sheet_id, columns=[column]).withColumn(f"{column} made", function(old))
        counts = [F.count_if(new.isNotNull() & (new != F.col(f"`{column} old`"))).alias("affected"), F.count_if(F.col(f"`{column} old`").isNotNull() & new.isNull()).alias("skipped")]
        made = both.select("*", old.alias(f"{column} old")).withColumn(column, F.coalesce(new, old))
        found = self._rewrite(sheet_id, made, [column], counts, kind, {"column": column, **params}, lambda n: n["affected"])
        return {"affected": found["affected"], "skipped": found["skipped"]}

    def replace(self, sheet_id: int, column: str, old: str, new: str, use_regex: bool = False) -> dict[str, int]:
        return self._transform(sheet_id, column, "replace", {"from": old, "to": new, "regex": use_regex}, lambda c: transforms.replace(c, old, new, use_regex))

    def replace_all(self, sheet_id: int, old: str, new: str, use_regex: bool = False) -> dict[str, int]:
        before = self.data(sheet_id)
        names = headers(before)
        mark = "_" * (1 + max(map(len, names), default=0))  # longer than any name
        was = {c: f"{mark}{i}" for i, c in enumerate(names)}
        made = columns.replace_all(before.withColumns({o: F.col(f"`{c}`") for c, o in was.items()}), old, new, use_regex, names)
        counts = [F.count_if(~F.col(o).eqNullSafe(F.col(f"`{c}`"))).alias(f"n{i}") for i, (c, o) in enumerate(was.items())]
        total = lambda n: sum(n[f"n{i}"] for i in range(len(names)))
        return {"affected": total(self._rewrite(sheet_id, made, names, counts, "replace_all", {"from": old, "to": new, "regex": use_regex}, total))}

    def write_cells(self, sheet_id: int, cells: DataFrame | Sequence[tuple[int, str, str | None]]) -> dict[str, int]:
        """Puts values into cells, rows that aren't there included; of a cell's several values the last holds.

        cells: row number, column and value of each, in order; or a DataFrame with _row_idx, column, value
        and, where a cell occurs more than once, _at to order by. Unknown columns are refused. What is
        written grows with the cells, not with the sheet.
        """
        if not isinstance(cells, DataFrame):
            cells = self.spark.createDataFrame([(r, c, v, k) for k, (r, c, v) in enumerate(cells)], f"{ROW} long, column string, value string, _at long")
        old = self.state(sheet_id)
        state, found = self.store.with_cells(old, cells)
        if found["written"]:
            touched = [c for c in state["columns"] if state["columns"][c] != old["columns"][c]]
            self._change(sheet_id, state, lambda before, after: self._operation(sheet_id, "edit", {"cells": found["written"]}, touched, before, after, found["written"]))
        return found

    def compact(self, sheet_id: int) -> None:
        """Merges edited cells and columns written anew into whole rows, in those ranges of rows that have any. Operations can be undone as before."""
        state = self.store.compacted(self.state(sheet_id))
        if state != self.state(sheet_id):
            self._change(sheet_id, state, lambda before, after: self._operation(sheet_id, "compact", {}))

    def base64(self, sheet_id: int, column: str, mode: str) -> dict[str, int]:
        if mode not in ("encode", "decode"):
            raise InvalidInput(f"unknown mode {mode!r}")
        return self._transform(sheet_id, column, "base64", {"mode": mode}, transforms.base64_encode if mode == "encode" else transforms.base64_decode)

    def hash(self, sheet_id: int, column: str, algorithm: str, upper: bool = False) -> dict[str, int]:
        return self._transform(sheet_id, column, "hash", {"algorithm": algorithm, "upper": upper}, lambda c: transforms.digest(c, algorithm, upper))

    def change_case(self, sheet_id: int, column: str, to: str) -> dict[str, int]:
        return self._transform(sheet_id, column, "transform", {"op": to}, lambda c: transforms.change_case(c, to))

    def mask(
        self, sheet_id: int, column: str, rule_id: str | None = None, replacement: str | None = None, template: dict[str, Any] | None = None, validate_rule_id: str | None = None,
        invalid_text: str = "INVALID", params_override: dict[str, Any] | None = None, phone_prefixes: Sequence[str] = (),
    ) -> dict[str, int]:
        """Masks all rows of a column; an unknown rule masks as no rule does. With a validating rule, values it refuses become invalid_text."""
        before = self.data(sheet_id, columns=self.sheets[sheet_id]["headers"] if column not in self.state(sheet_id)["columns"] else [column])
        columns.check_column(before, column)
        rule = self.rules.find(rule_id)
        own = template_from(template)
        own = None if own is not None and own.is_empty() else own
        if replacement or own is not None:
            rule = rule or Rule("runtime", "runtime", "mask")
            rule = replace(rule, **({"replacement": replacement} if replacement else {}), **({"template": own} if own is not None else {}))
        value = F.col(f"`{column}`")
        if validate_rule_id:
            verdict = validate.verdict(value, self.rules.get(validate_rule_id), params_override, validators.phone_prefixes(phone_prefixes))
            made = validate_then_mask(value, verdict["valid"], rule, invalid_text)
        else:
            made = mask(value, rule)
        found = self._rewrite(sheet_id, before.withColumn(column, made), [column], [], "mask", {"column": column, "rule": rule_id}, lambda n: n["_rows"])
        return {"affected": found["_rows"]}

    # undo

    def undoable(self, sheet_id: int) -> list[dict[str, Any]]:
        """The latest operations that can be undone, newest first, with a mark on those that are."""
        own = [o for o in self.operations.values() if o["sheet_id"] == sheet_id and o["kind"] in UNDOABLE]
        return sorted(own, key=lambda o: -o["id"])[:UNDO_LIST]

    def _restore(self, operation_id: int, source: str, target: str, undone: bool) -> dict[str, int]:
        """Puts back an operation's columns. Where a column is as the operation left it, its state is swapped; else the cells that the operation changed are written over it."""
        operation = self.operations.get(operation_id)
        if operation is None or operation["before_version"] is None:
            raise ProcessorError(f"operation {operation_id} can't be undone")
        sheet_id = operation["sheet_id"]
        left, wanted = (self.state(sheet_id, operation[v]) for v in (source, target))
        state = self.state(sheet_id)
        # rows and whole pieces may have come since: a column's state says where it is only among the same pieces
        same = [c for c in operation["columns"] if state["columns"][c] == left["columns"][c] and state["pieces"] == left["pieces"]]
        state = {**state, "columns": {c: wanted["columns"][c] if c in same else own for c, own in state["columns"].items()}}
        others = [c for c in operation["columns"] if c not in same]
        if others:
            at = self.store.read(left, others).select(ROW, *[F.col(f"`{c}`").alias(f"_l{i}") for i, c in enumerate(others)])
            to = self.store.read(wanted, others).select(ROW, *[F.col(f"`{c}`").alias(f"_w{i}") for i, c in enumerate(others)])
            cells = F.array_compact(F.array(*[F.when(~F.col(f"_l{i}").eqNullSafe(F.col(f"_w{i}")), F.struct(F.lit(c).alias("column"), F.col(f"_w{i}").cast("string").alias("value"))) for i, c in enumerate(others)]))
            state, _ = self.store.with_cells(state, at.join(to, ROW, "full").select(ROW, F.explode(cells).alias("cell")).select(ROW, "cell.*"))
        kind = "undo" if undone else "redo"
        self._change(sheet_id, state, lambda before, after: self._operation(sheet_id, kind, {"operation": operation_id}, operation["columns"]), [{**operation, "undone": undone}])
        return {"restored": operation["affected"]}

    def undo(self, operation_id: int) -> dict[str, int]:
        return self._restore(operation_id, "after_version", "before_version", True)

    def redo(self, operation_id: int) -> dict[str, int]:
        return self._restore(operation_id, "before_version", "after_version", False)

    # operations that make sheets

    def expand_json(self, sheet_id: int, column: str) -> dict[str, Any]:
        source = self.data(sheet_id)
        made = number_rows(columns.expand_json(source, column).orderBy("source_row").drop("source_row"), in_files=False)
        new = self.add_sheet(self.sheets[sheet_id]["session_id"], f"{column}_json", made)
        rows = self.data(new).count()
        self._log(sheet_id, "parse_json", {"column": column})
        return {"sheet_id": new, "headers": headers(made), "row_count": rows, "skipped": source.count() - rows}

    def extract(self, sheet_id: int, column: str, rule_ids: Sequence[str], gender_column: str | None = None, phone_prefixes: Sequence[str] = (), idcard_allow_leading_zero: bool = False, join_chunks: bool = True) -> dict[str, Any]:
        """Valid finds of the rules in a new sheet. Rows of a txt import are searched as one text without separators, unless join_chunks is False."""
        source = self.data(sheet_id)
        columns.check_column(source, column)
        rules = [self.rules.get(r) for r in rule_ids]
        session = self.sessions[self.sheets[sheet_id]["session_id"]]
        options = {"phone_prefixes": validators.phone_prefixes(phone_prefixes), "idcard_allow_leading_zero": idcard_allow_leading_zero, "joined": join_chunks and session["source_type"] == "txt"}
        found = extract.extract(source, column, rules, gender_column, **options)
        made = number_rows(extract.extracted_sheet(found), in_files=False)
        new = self.add_sheet(session["id"], f"{column}_{extract.SUFFIX}", made)
        skipped = extract.rows_without_candidates(source, column, rules, **options).first()["skipped"]
        self._log(sheet_id, "extract", {"column": column, "rules": list(rule_ids)})
        return {"sheet_id": new, "headers": headers(made), "row_count": self.data(new).count(), "skipped": skipped}

    def validate_split(self, sheet_id: int, rules: Sequence[dict[str, Any]], phone_prefixes: Sequence[str] = ()) -> dict[str, Any]:
        """Two new sheets, of valid and of invalid rows, and the reasons as a DataFrame. rules: column, rule_id, cross_field?, params?."""
        source, own = self.data(sheet_id), self.sheets[sheet_id]
        made = [validate.ColumnRule(r["column"], self.rules.get(r["rule_id"]), validate.CrossField(**r["cross_field"]) if r.get("cross_field") else None, r.get("params")) for r in rules]
        checked = validate.with_reasons(source, made, validators.phone_prefixes(phone_prefixes))
        good, bad = validate.split(checked)
        ids = [self.add_sheet(own["session_id"], f"{own['name']}_{suffix}", number_rows(part.orderBy(ROW).drop(ROW), in_files=False)) for part, suffix in ((good, "校验通过"), (bad, "校验失败"))]
        self._log(sheet_id, "validate", {"rules": [r["rule_id"] for r in rules]})
        return {"valid_sheet": ids[0], "invalid_sheet": ids[1], "reasons": validate.reasons(checked)}

    # search

    def search_rows(self, sheet_id: int, query: str, use_regex: bool = False, column: str | None = None, page: int = 1, size: int = 50) -> dict[str, Any]:
        df = self.data(sheet_id)
        found = search.search_rows(df, query, use_regex, None if column is None else [column])
        rows, total = search.result_page(search.with_hits(found, query, use_regex), [ROW], page, size) if query else ([], 0)
        return {"rows": [r.asDict(True) for r in rows], "total": total}

    def search_cells(self, sheet_id: int, query: str, use_regex: bool = False, column: str | None = None, page: int = 1, size: int = 50) -> dict[str, Any]:
        if not query:
            return {"cells": [], "total": 0}
        found = search.search_cells(self.data(sheet_id), query, use_regex, None if column is None else [column])
        rows, total = search.result_page(found, [ROW, "col_idx"], page, size)
        return {"cells": [r.asDict() for r in rows], "total": total}
