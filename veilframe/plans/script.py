"""SQL scripts: cut into statements, cleaned of what other databases add, and run as Spark SQL over temporary views."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from veilframe.errors import DataSourceError, Unsupported
from veilframe.operators.sheet import union_by_name

_piece = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`)|(--[^\n]*|/\*.*?\*/)|(;)""", re.S)
_skipped = re.compile(r"(?i)\s*(use|set|create\s+database|lock\s+tables|unlock\s+tables|begin|commit|start\s+transaction|pragma)\b")
_create = re.compile(r"(?is)\s*create\s+(?:temp\w*\s+)?table\s+(if\s+not\s+exists\s+)?([`\"\w.]+)\s*\((.*)\)")
_as_select = re.compile(r"(?is)\s*create\s+(?:temp\w*\s+)?table\s+(if\s+not\s+exists\s+)?([`\"\w.]+)\s+as\s+(select\b.*|with\b.*)")
_default = re.compile(r"""(?is)\bdefault\s+('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|[-+]?\s*[\d.]+(?:e[-+]?\d+)?\b|\w+|\()""")
_literal = re.compile(r"(?is)'.*'|\".*\"|[-+]?\s*[\d.]+(?:e[-+]?\d+)?|null|true|false")
_key = re.compile(r"(?is)\s*(?:constraint\s+\S+\s+)?(?:primary\s+key|unique(?:\s+(?:key|index))?(?:\s+[`\"\w]+)?)\s*\((.*)\)")
_drop = re.compile(r"(?is)\s*drop\s+(?:temporary\s+)?table\s+(if\s+exists\s+)?([`\"\w.\s,]+?)(?:\s+(?:restrict|cascade))?\s*\Z")
_alter = re.compile(r"(?is)\s*alter\s+table\s+([`\"\w.]+)\s+(.*)")
_rename = re.compile(r"(?is)\s*rename\s+(?:to|as)\s+([`\"\w.]+)\s*\Z")
_rename_column = re.compile(r"(?is)\s*rename\s+(?:column\s+)?([`\"\w]+)\s+to\s+([`\"\w]+)\s*\Z")
_drop_column = re.compile(r"(?is)\s*drop\s+(?:column\s+)?([`\"\w]+)\s*\Z")
_add_column = re.compile(r"(?is)\s*add\s+(?:column\s+)?([`\"\w]+)(?:\s+(\w+(?:\s+\w+)*(?:\s*\([\d\s,]*\))?))??(?:\s+null)?\s*\Z")
_filled = re.compile(r"(?i)\b(default|not\s+null|first|after|generated|as|check|references|unique|primary)\b")
_insert = re.compile(r"(?is)\s*insert\s+into\s+([`\"\w.]+)\s*(?:\(([^)]*)\))?\s*(values\b.*|select\b.*)")
_update = re.compile(r"(?is)\s*update\s+([`\"\w.]+)\s+set\s+(.*?)(?:\s+where\s+(.*))?\Z")
_delete = re.compile(r"(?is)\s*delete\s+from\s+([`\"\w.]+)(?:\s+where\s+(.*))?\Z")
_constraint = re.compile(r"(?i)\s*(primary|unique|key|index|constraint|foreign|check|fulltext)\b")


def statements(script: str) -> list[str]:
    """Statements without comments; semicolons in quotes don't end one."""
    out, own, at = [], [], 0
    for m in _piece.finditer(script):
        own.append(script[at : m.start()])
        at = m.end()
        if m[1]:
            own.append(m[1])
        elif m[2]:
            own.append(" ")
        else:
            out.append("".join(own).strip())
            own = []
    out.append(("".join(own) + script[at:]).strip())
    return [s for s in out if s]


def _split(text: str) -> list[str]:
    """Parts between commas that stand in no quotes or brackets."""
    out, depth, own = [], 0, []
    for token in re.findall(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|.""", text, re.S):
        depth += (token == "(") - (token == ")")
        if token == "," and depth == 0:
            out.append("".join(own))
            own = []
        else:
            own.append(token)
    return [*out, "".join(own)]


def _name(text: str) -> str:
    return text.strip().split(".")[-1].strip('`"')


def _type(declared: str) -> str:
    declared = declared.lower()
    if "int" in declared:
        return "bigint"
    return "double" if re.search("real|floa|doub|dec|num", declared) else "string"


def joined_inserts(found: list[str]) -> list[str]:
    """The statements, with INSERTs of values that follow each other into the same columns as one, so that a dump makes few plans."""
    groups, last = [], None
    for s in found:
        m = _insert.match(s)
        head = (m[1], m[2]) if m and m[3][:6].lower() == "values" else None
        if head is not None and head == last:
            groups[-1].append(m[3][6:].strip())
        else:
            groups.append([s])
        last = head
    return [", ".join(g) for g in groups]


@dataclass
class Rules:
    """What a table's declaration asks of its rows: values of columns that are not given, columns without nulls, columns (or several together) without repeats, and one that numbers rows."""

    defaults: dict[str, str]
    required: set[str]
    keys: list[tuple[str, ...]]
    numbered: str | None = None

    def renamed(self, source: dict[str, str | None]) -> Rules:
        """For columns that come of others; keys of dropped columns go."""
        new = {old: own for own, old in source.items() if old is not None}
        of = lambda names: tuple(new[c] for c in names)
        return Rules({new[c]: d for c, d in self.defaults.items() if c in new}, {new[c] for c in self.required if c in new}, [of(k) for k in self.keys if all(c in new for c in k)], new.get(self.numbered))


def _rules(parts: list[str]) -> tuple[dict[str, str], Rules]:
    """Types of the columns of a declaration, and its rules."""
    kinds, rules = {}, Rules({}, set(), [])
    for part in parts:
        if m := _key.match(part):
            rules.keys.append(tuple(_name(c.partition("(")[0]) for c in _split(m[1])))
        elif part.strip() and not _constraint.match(part):
            own, _, declared = part.strip().partition(" ")
            name = _name(own)
            kinds[name] = _type(declared)
            bare = re.sub(r"""'(?:[^'\\]|\\.|'')*'|"[^"]*\"""", "''", declared)
            if m := _default.search(declared):
                rules.defaults[name] = m[1]
            if re.search(r"(?i)\bnot\s+null\b", bare):
                rules.required.add(name)
            if re.search(r"(?i)\b(primary\s+key|unique)\b", bare):
                rules.keys.append((name,))
            if re.search(r"(?i)\bauto_?increment\b|\A\s*integer\s+primary\s+key\b", bare):
                rules.numbered = name
    return kinds, rules


@dataclass
class ScriptResult:
    """The combined result of a script's queries, and the tables it leaves."""

    result: DataFrame | None
    tables: dict[str, DataFrame]


class ScriptRunner:
    """Tables of a script are DataFrames behind temporary views of its own names; changes make new DataFrames."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.columns, self.rules, self.last = spark, {}, {}, {}, None
        self.prefix = f"script_{uuid.uuid4().hex[:12]}_"

    def _store(self, table: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(self.prefix + table)
        self.tables[table] = df

    def add(self, name: str, df: DataFrame) -> None:
        """A table of the script's that is there before it runs."""
        self.columns[name], self.rules[name] = {f.name: f.dataType.simpleString() for f in df.schema}, Rules({}, set(), [])
        self._store(name, df)

    def _query(self, text: str) -> DataFrame:
        """Runs a query with table names pointed at the views; names in quotes that are strings stay."""
        parts = re.split(r"('(?:[^'\\]|\\.|'')*')", text)
        for i in range(0, len(parts), 2):
            part = re.sub(r'"([^"]*)"', r"`\1`", parts[i])
            for table in self.tables:
                part = re.sub(rf"(?i)(\b(?:from|join)\s+|,\s*)`?{re.escape(table)}`?(?![\w`.])(?!\s*\()(?=\s+(?!as\b|where\b|join\b|on\b|group\b|order\b|limit\b|left\b|right\b|inner\b|cross\b|full\b|union\b|having\b|natural\b|using\b|except\b|intersect\b|window\b)\w|\s+as\b)", rf"\g<1>{self.prefix}{table}", part)
                part = re.sub(rf"(?i)(\b(?:from|join)\s+)`?{re.escape(table)}`?(?![\w`.(])", rf"\g<1>{self.prefix}{table} {table}", part)
            parts[i] = part
        try:
            return self.spark.sql("".join(parts))
        except Exception as e:  # what Spark says about the statement
            raise DataSourceError(f"{str(e).splitlines()[0]} in: {text[:200]}") from None

    def _known(self, name: str) -> str:
        table = _name(name)
        if table not in self.tables:
            raise DataSourceError(f"no such table: {table}")
        return table

    def _forget(self, table: str) -> None:
        self.spark.catalog.dropTempView(self.prefix + table)
        del self.tables[table], self.columns[table], self.rules[table]

    def _check(self, table: str) -> None:
        """Raises for rows that the table's declaration forbids."""
        df, rules = self.tables[table], self.rules[table]
        quoted = lambda names: [f"`{c}`" for c in names]
        if rules.required and not df.filter(" OR ".join(f"{c} IS NULL" for c in quoted(sorted(rules.required)))).isEmpty():
            raise DataSourceError(f"a column of {table} that allows no nulls has some: {', '.join(sorted(rules.required))}")
        for key in rules.keys:
            given = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in quoted(key)))
            if not given.groupBy(*quoted(key)).count().filter("count > 1").isEmpty():
                raise DataSourceError(f"values of {table} that must differ repeat: {', '.join(key)}")

    def _missing(self, table: str, column: str, kind: str) -> str:
        """What a column holds that an INSERT doesn't give."""
        rules = self.rules[table]
        default = rules.defaults.get(column)
        if column == rules.numbered or (default is not None and not _literal.fullmatch(default)):
            raise Unsupported(f"statement not supported: INSERT into {table} without {column}, which is made up of other values")
        if default is not None and default[0] == '"':
            default = "'" + default[1:-1].replace("'", "\\'") + "'"
        return f"try_cast({default or 'NULL'} AS {kind}) AS `{column}`"

    def _alter(self, table: str, change: str) -> None:
        """One change of a table; keys and constraints change no rows."""
        kinds = self.columns[table]
        if re.match(r"(?i)\s*add\b", change) and _constraint.match(change.strip()[3:]):
            return
        if m := _rename.match(change):
            new = _name(m[1])
            if new in self.tables:
                raise DataSourceError(f"table already exists: {new}")
            df, rules = self.tables[table], self.rules[table]
            self._forget(table)
            self.rules[new] = rules
            self.columns[new], self.last = kinds, new if self.last == table else self.last
            self._store(new, df)
            return
        source, added = {c: c for c in kinds}, None
        if m := _rename_column.match(change):
            old, new = _name(m[1]), _name(m[2])
            source = {new if c == old else c: c for c in kinds}
            done = old in kinds and len(source) == len(kinds)
        elif m := _drop_column.match(change):
            old = _name(m[1])
            done = source.pop(old, None) is not None and len(source) > 0
        elif (m := _add_column.match(change)) and not _filled.search(change):
            new, added = _name(m[1]), _type(m[2] or "")
            done = new not in kinds
            source[new] = None
        else:
            raise Unsupported(f"statement not supported: ALTER TABLE {table} {change.strip()[:80]}")
        if not done:
            raise DataSourceError(f"table {table} does not allow: {change.strip()[:80]}")
        self.columns[table] = {c: added if own is None else kinds[own] for c, own in source.items()}
        self.rules[table] = self.rules[table].renamed(source)
        self._store(table, self.tables[table].selectExpr(*[f"cast(NULL AS {added}) AS `{c}`" if own is None else f"`{own}` AS `{c}`" for c, own in source.items()]))

    def run(self, statement: str) -> None:
        """One statement that isn't a query."""
        if _skipped.match(statement):
            return
        if m := _as_select.match(statement) or _create.match(statement):
            table = _name(m[2])
            if table in self.tables:
                if m[1]:
                    return
                raise DataSourceError(f"table already exists: {table}")
            self.last = table
            if m.re is _as_select:
                made = self._query(m[3])
                self.columns[table], self.rules[table] = {f.name: f.dataType.simpleString() for f in made.schema}, Rules({}, set(), [])
                self._store(table, made)
            else:
                self.columns[table], self.rules[table] = kinds, _ = _rules(_split(m[3]))
                self._store(table, self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in kinds.items())))
        elif m := _insert.match(statement):
            table = self._known(m[1])
            kinds = self.columns[table]
            given = [_name(c) for c in m[2].split(",")] if m[2] else list(kinds)
            values = re.sub(r'(?<![\w\\])"((?:[^"\\]|\\.)*)"', r"'\1'", m[3]) if m[3][:6].lower() == "values" else m[3]
            rows = self._query(values if values[:6].lower() == "select" else f"SELECT * FROM {values}")
            rows = rows.toDF(*given)
            made = rows.selectExpr(*[(f"try_cast(`{c}` AS {t}) AS `{c}`" if c in given else self._missing(table, c, t)) for c, t in kinds.items()])
            self._store(table, self.tables[table].unionByName(made))
            self._check(table)
        elif m := _update.match(statement):
            table = self._known(m[1])
            new = {_name(a.partition("=")[0]): a.partition("=")[2] for a in _split(m[2])}
            where = f"coalesce({m[3]}, false)" if m[3] else "true"
            columns = [f"try_cast(CASE WHEN {where} THEN {new[c]} ELSE `{c}` END AS {t}) AS `{c}`" if c in new else f"`{c}`" for c, t in self.columns[table].items()]
            self._store(table, self.tables[table].selectExpr(*columns))
            self._check(table)
        elif m := _delete.match(statement):
            table = self._known(m[1])
            self._store(table, self.tables[table].filter(f"NOT coalesce({m[2]}, false)" if m[2] else "false"))
        elif m := _drop.match(statement):
            for name in m[2].split(","):
                if not m[1] or _name(name) in self.tables:
                    self._forget(self._known(name))
        elif m := _alter.match(statement):
            for change in _split(m[2]):
                self._alter(self._known(m[1]), change)
        elif re.match(r"(?i)\s*(with|values|create\s+(unique\s+)?index|(alter|drop)\s+database|drop\s+(index|view|trigger))\b", statement):
            return  # no rows come of these
        else:
            raise Unsupported(f"statement not supported: {statement[:80]}")

    def script(self, text: str) -> ScriptResult:
        """All other statements run before the queries, whose results are united by column name; without one the last table made is the result."""
        found = statements(text)
        is_query = lambda s: re.match(r"(?i)select\b", s) is not None
        for s in joined_inserts([s for s in found if not is_query(s)]):
            self.run(s)
        queries = [s for s in found if is_query(s)] or ([f"SELECT * FROM {self.last}"] if self.last else [])
        result = union_by_name([("", self._query(q)) for q in queries]) if queries else None
        return ScriptResult(result, self.tables)
