"""What the operators of this subpackage share: tables, checkpoints, splits, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.storage import fresh_path, written  # noqa: F401

#: Rows of a batch that Python handles at once; keeps a worker's copies of long texts few.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no model may learn from (a null id counts as the text '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same in every run and every engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column; null reads as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


#: Ids up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def if_small(ids: DataFrame, most: int | None = None) -> DataFrame:
    """ids (narrow rows, written ones) marked for broadcast if there are `most` (BROADCAST_IDS) at most."""
    most = BROADCAST_IDS if most is None else most
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


#: At most so many keys count as hot: those with more than 1 / HOT_KEYS of all rows.
HOT_KEYS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """rows left-joined to groups (one row a key, with its number of rows in `copies`) without gathering a hot key in one task.

    Keys with a large share of all rows, at most HOT_KEYS of them, are broadcast; the others shuffle.
    Both tables are read twice, so they should be written ones. Rows with a null key match nothing.
    """
    bound = max(100, total // HOT_KEYS)
    hot = F.broadcast(groups.filter(F.col(copies) > bound))
    cold = groups.filter(F.col(copies) <= bound)
    rest = rows.filter(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti").join(cold, key, "left")
    return rows.join(hot, key).unionByName(rest).unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def keep_rows(docs: DataFrame, columns: list[str], keep) -> DataFrame:
    """Rows of docs, all columns as they are, for which keep(batch of the named columns) gives True; no shuffle.

    keep takes an Arrow batch and returns a list of booleans.
    """
    order = [docs.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = pa.RecordBatch.from_arrays([part.column(i) for i in order], columns)
            yield part.filter(pa.array(keep(own), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
