"""In-place transforms of sheet columns with their counts, and expansion of JSON columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.errors import InvalidInput
from veilframe.functions import transforms
from veilframe.operators.sheet import ROW, headers


def check_column(sheet: DataFrame, column: str) -> None:
    if column not in headers(sheet):
        raise InvalidInput(f"列 `{column}` 不存在")


def apply(sheet: DataFrame, column: str, function: Callable[[Column], Column]) -> DataFrame:
    """The sheet with the column's values transformed; where the function gives null the value stays."""
    check_column(sheet, column)
    value = F.col(f"`{column}`")
    return sheet.withColumn(column, F.coalesce(function(value), value))


def effect(sheet: DataFrame, column: str, function: Callable[[Column], Column]) -> DataFrame:
    """affected: values that change; skipped: values that the function can't take."""
    check_column(sheet, column)
    value = F.col(f"`{column}`")
    made = function(value)
    return sheet.select(F.count_if(made.isNotNull() & (made != value)).alias("affected"), F.count_if(value.isNotNull() & made.isNull()).alias("skipped"))


def replace_all(sheet: DataFrame, old: str, new: str, use_regex: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Replacement in every column (or the named ones); headers stay."""
    names = headers(sheet) if columns is None else columns
    return sheet.withColumns({c: transforms.replace(F.col(f"`{c}`"), old, new, use_regex) for c in names})


def changed_cells(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """affected: cells that differ between two versions with the same rows."""
    joined = before.select(ROW, *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)]).join(after, ROW)
    differ = [F.count_if(~F.col(f"_{i}").eqNullSafe(F.col(f"`{c}`"))) for i, c in enumerate(columns)]
    return joined.select(sum(differ[1:], differ[0]).alias("affected"))


#: One JSON object and nothing after it; strings, numbers and nesting are checked by the parser itself.
_OBJECT = r"(?s)\A\s*\{.*\}\s*\z"


def json_objects(text: Column) -> Column:
    """map<string,string> of a JSON object, nested values as compact JSON; null for everything else."""
    one = text.rlike(_OBJECT) & F.json_object_keys(text).isNotNull() & (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1)
    return F.when(one, F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"}))


def json_headers(objects: DataFrame, column: str = "object") -> list[str]:
    """Keys in the order first seen (by _row_idx, then place). One row a key reaches the driver."""
    seen = objects.select(ROW, F.posexplode(F.map_keys(column)).alias("_at", "_key")).groupBy("_key").agg(F.min(F.struct(ROW, "_at")).alias("_first"))
    return [r["_key"] for r in seen.orderBy("_first").collect()]


def expand_json(sheet: DataFrame, column: str, names: Sequence[str] | None = None) -> DataFrame:
    """A sheet of the objects in a column, one column a key: rows that aren't objects are left out, JSON null and "" are null.

    names: the keys, where they are known; else they are looked for first. source_row tells where a row came from.
    """
    check_column(sheet, column)
    objects = sheet.select(F.col(ROW), json_objects(F.col(f"`{column}`")).alias("object")).filter("object is not null")
    names = json_headers(objects) if names is None else names
    return objects.select(F.col(ROW).alias("source_row"), *[F.nullif(F.try_element_at("object", F.lit(n)), F.lit("")).alias(n) for n in names])
