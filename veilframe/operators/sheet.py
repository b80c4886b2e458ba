"""Dense row numbers in file order, paging, projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.storage import fresh_path

ROW = "_row_idx"
#: Row ids up to this number are compared in the filter itself; more are joined.
INLINE_ROWS = 1000
#: Starts of file blocks (a path and two numbers each) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 100_000


def number_rows(df: DataFrame, in_files: bool = True) -> DataFrame:
    """df with _row_idx 1, 2, ... in the order of files and of rows in them (or of partitions, if not read from files).

    One pass counts the rows of each file block; only these counts, a row a block, are put in order. The
    rows themselves aren't shuffled. What isn't read from files is written to the shared folder first and
    numbered from there: two evaluations of a shuffle can cut its partitions in different places.
    """
    names = df.columns
    rows = df.toDF(*[f"c{i}" for i in range(len(names))])
    at = F.monotonically_increasing_id().alias("_at")
    if in_files:
        marked = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), at)
    else:
        made, path = rows.select("*", F.lit("").alias("_file"), F.spark_partition_id().cast("long").alias("_block"), at), fresh_path(df.sparkSession, "rows")
        made.write.parquet(path)
        marked = df.sparkSession.read.schema(made.schema).parquet(path)
    blocks = marked.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a block
    starts = blocks.select("_file", "_block", (before - F.col("_first") + 1).alias("_shift"))
    # files and partitions together are at least as many as blocks, and are known without a job
    few = marked.rdd.getNumPartitions() + len(marked.inputFiles()) <= BROADCAST_BLOCKS
    numbered = marked.join(F.broadcast(starts) if few else starts, ["_file", "_block"])
    return numbered.select((F.col("_at") + F.col("_shift")).alias(ROW), *[f"c{i}" for i in range(len(names))]).toDF(ROW, *names)


def headers(sheet: DataFrame) -> list[str]:
    return [c for c in sheet.columns if c != ROW]


def page(sheet: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Rows of a page in order; page 0 is page 1. Row numbers are dense, so a page is a range and no rows are skipped over."""
    first = (max(number, 1) - 1) * size
    return sheet.filter(F.col(ROW).between(first + 1, first + size)).orderBy(ROW)


def project(sheet: DataFrame, columns: Sequence[str]) -> DataFrame:
    return sheet.select(ROW, *[F.col(f"`{c}`") for c in columns])


def select_rows(sheet: DataFrame, rows: Sequence[int] | DataFrame) -> DataFrame:
    """Rows by number: a list, or a DataFrame with _row_idx."""
    if not isinstance(rows, DataFrame):
        if len(rows) <= INLINE_ROWS:
            return sheet.filter(F.col(ROW).isin(*rows)) if rows else sheet.limit(0)
        rows = sheet.sparkSession.createDataFrame([(r,) for r in rows], f"{ROW} long")
    return sheet.join(rows.select(ROW).distinct(), ROW, "left_semi")


def column_cells(sheet: DataFrame, column: str) -> DataFrame:
    return sheet.select(ROW, F.col(f"`{column}`").alias("value"))


def column_page(sheet: DataFrame, column: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """_row_idx, value of `limit` rows after the first `offset`, in order: a range of row numbers, so a scan that needs no sort of the sheet."""
    return column_cells(sheet, column).filter(F.col(ROW).between(offset + 1, offset + limit)).orderBy(ROW)


def cells(sheet: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long form: _row_idx, col_idx, value. Nulls are kept."""
    names = headers(sheet)
    wanted = names if columns is None else list(columns)
    long = F.explode(F.array(*[F.struct(F.lit(names.index(c)).alias("col_idx"), F.col(f"`{c}`").cast("string").alias("value")) for c in wanted]))
    return sheet.select(ROW, long.alias("cell")).select(ROW, "cell.col_idx", "cell.value")


def wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """The inverse of cells(): one row per _row_idx. The columns are known, so no pass looks for them."""
    made = long.groupBy(ROW).agg(*[F.max(F.when(F.col("col_idx") == i, F.col("value"))).alias(n) for i, n in enumerate(names)])
    return made.select(ROW, *[F.col(f"`{n}`") for n in names])


def union_by_name(frames: Sequence[tuple[str, DataFrame]], label: str | None = None) -> DataFrame:
    """Rows of all frames as strings, columns in the order first seen, missing ones and nulls empty; with label a first column that names the frame."""
    names = list(dict.fromkeys(c for _, f in frames for c in f.columns))
    parts = []
    for name, f in frames:
        columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in f.columns else F.lit("").alias(c) for c in names]
        parts.append(f.select(*([F.lit(name).alias(label)] if label else []), *columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
