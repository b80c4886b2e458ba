"""Keyword and pattern search over cells and rows, with the places of the matches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veilframe.functions import regex, transforms
from veilframe.operators.sheet import ROW, cells, headers


def _predicate(query: str, use_regex: bool):
    if use_regex:
        java = regex.checked(query)
        return lambda c: c.rlike(java)
    return lambda c: transforms.contains_keyword(c, query)


def _spans(value: Column, query: str, use_regex: bool) -> Column:
    return transforms.pattern_spans(value, query) if use_regex else transforms.keyword_spans(value, query)


def search_cells(sheet: DataFrame, query: str, use_regex: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """_row_idx, col_idx, value of the cells that match; null cells never do. A keyword matches ASCII letters in either case."""
    return cells(sheet, columns).filter(F.col("value").isNotNull() & _predicate(query, use_regex)(F.col("value")))


def search_rows(sheet: DataFrame, query: str, use_regex: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which one of the columns (all by default) matches; an empty query finds none."""
    if not query:
        return sheet.limit(0)
    test = _predicate(query, use_regex)
    names = headers(sheet) if columns is None else columns
    return sheet.filter(reduce(lambda a, b: a | b, [F.coalesce(test(F.col(f"`{c}`")), F.lit(False)) for c in names]))


def with_hits(rows: DataFrame, query: str, use_regex: bool = False) -> DataFrame:
    """_row_idx, cells, hits of rows that matched: places are looked for in all columns, in UTF-8 bytes.

    A keyword's places are case-sensitive, so a cell that matches in other case has a hit without places.
    """
    test = _predicate(query, use_regex)
    names = headers(rows)
    hit = [
        F.when(F.coalesce(test(F.col(f"`{c}`")), F.lit(False)), F.struct(F.lit(i).alias("col_idx"), F.col(f"`{c}`").alias("value"), _spans(F.col(f"`{c}`"), query, use_regex).alias("matches")))
        for i, c in enumerate(names)
    ]
    return rows.select(ROW, F.array(*[F.col(f"`{c}`") for c in names]).alias("cells"), F.array_compact(F.array(*hit)).alias("hits"))


def result_page(found: DataFrame, order: Sequence[str], number: int = 1, size: int = 50) -> tuple[list, int]:
    """One page of results and their total number, in one job: rows are counted on their way to the page's top rows."""
    first, seen = (max(number, 1) - 1) * size, Observation()
    rows = found.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*order).limit(first + size).offset(first).collect()
    return rows, seen.get["n"]
