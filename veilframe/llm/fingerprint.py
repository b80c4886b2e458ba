"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, modulo a prime, the running sum of code point times power. The hash
of any span is a difference of two entries, so equality of spans takes constant time and the
longest common extension of two positions is found by binary search. The fingerprint keeps the
hash of the whole text and the smallest distinct hashes of its spans of two fixed widths.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import slices, texts

PRIME = (1 << 31) - 1
BASES = (911382323, 972663749)
#: Spans sketched, in code points: two texts compare by SPAN if both have SHORT code points or more, else by SHORT_SPAN, so any two compare.
SPAN, SHORT_SPAN, SHORT = 16, 4, 64
#: Hashes of a sketch, and of the sketch by SHORT_SPAN of texts that are not short themselves.
SKETCH, FINE = 64, 32
#: Documents of one range of ids (neighbours meet in a range); at least MIN_RANGES ranges.
RANGE_ROWS, MIN_RANGES, MAX_RANGES = 20_000, 1024, 20_000
#: An id that fills so many ranges is cut by its texts, too.
HOT_RANGES = 4

_LAST = 2**63 - 1  # where rows without an id stand in the order
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    found = _tables.get(base)
    if found is None or len(found) < n:
        found = np.ones(1, np.int64)
        while len(found) < n:  # doubles the table: the upper half is the lower one times base**len
            found = np.concatenate([found, found * pow(base, len(found), PRIME) % PRIME])
        _tables[base] = found
    return found


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class PrefixHashes:
    """Prefix arrays of one text under each base."""

    def __init__(self, points: np.ndarray, shared: PrefixHashes | None = None, upto: int = 0):
        """With shared, the first upto code points are those of shared and their part of its arrays is reused."""
        self.points, self.sums = points, []
        for k, base in enumerate(BASES):
            sums = np.zeros(len(points) + 1, np.int64)
            if upto:
                sums[: upto + 1] = shared.sums[k][: upto + 1]
            rest = np.cumsum((points[upto:] + 1) * _powers(base, len(points) + 1)[upto : len(points)] % PRIME)
            sums[upto + 1 :] = (rest + sums[upto]) % PRIME
            self.sums.append(sums)

    def __len__(self) -> int:
        return len(self.points)

    def spans(self, starts: np.ndarray, width: int) -> np.ndarray:
        """uint64 hash of the spans of that width, comparable between texts."""
        out = np.zeros(len(starts), np.uint64)
        for base, sums in zip(BASES, self.sums, strict=True):
            shift = _powers(pow(base, -1, PRIME), len(self) + 1)
            value = (sums[starts + width] - sums[starts]) % PRIME * shift[starts] % PRIME
            out = (out << np.uint64(31)) | value.astype(np.uint64)
        return out

    def span(self, start: int, width: int) -> int:
        return int(self.spans(np.array([start]), width)[0])


def equal_spans(a: PrefixHashes, i: int, b: PrefixHashes, j: int, width: int) -> bool:
    return a.span(i, width) == b.span(j, width)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest span that starts at i in a and at j in b."""
    low, high = 0, min(len(a) - i, len(b) - j)
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _sketch(hashes: PrefixHashes, width: int, most: int) -> np.ndarray:
    """The smallest distinct hashes of the spans of that width (of the whole text, if it is shorter)."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    width = min(n, width)
    order = hashes.spans(np.arange(n - width + 1), width) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)
    few = order[order < np.uint64(min(2**48, 4 * most * 2**48 // len(order)))]
    found = np.unique(few)
    if len(found) < most and len(few) < len(order):
        found = np.unique(order)
    return found[:most]


class Print(NamedTuple):
    """A fingerprint: length:whole hash:wide:fine in hex, the length, and the two sketches (wide is empty for short texts)."""

    text: str
    size: int
    wide: np.ndarray
    fine: np.ndarray


def fingerprint(hashes: PrefixHashes) -> Print:
    """Equal texts have equal fingerprints."""
    n = len(hashes)
    wide = _sketch(hashes, SPAN, SKETCH) if n >= SHORT else np.empty(0, np.uint64)
    fine = _sketch(hashes, SHORT_SPAN, FINE if n >= SHORT else SKETCH)
    written = [x.astype(">u8").tobytes().hex() for x in (wide, fine)]
    return Print(":".join([str(n), f"{hashes.span(0, n):016x}", *written]), n, wide, fine)


def likeness(a: Print, b: Print) -> float:
    """Estimated share (Dice) of common spans, from two fingerprints; 1 for equal ones."""
    if a.text == b.text:
        return 1.0
    wide = min(a.size, b.size) >= SHORT
    x, y = (a.wide, b.wide) if wide else (a.fine, b.fine)
    if not len(x) or not len(y):
        return 0.0
    full = [most for own, most in ((x, FINE if not wide and a.size >= SHORT else SKETCH), (y, FINE if not wide and b.size >= SHORT else SKETCH)) if len(own) == most]
    both = np.union1d(x, y)[: min(full, default=len(x) + len(y))]
    share = len(np.intersect1d(np.intersect1d(both, x, True), y, True)) / len(both)
    return 2 * share / (1 + share)


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_common_prefix long"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_common_prefix", pa.int64()),
])


class _Document:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.hashes = PrefixHashes(code_points(text))
        self.print = fingerprint(self.hashes)

    def row(self, following: _Document) -> tuple:
        n = len(self.text)
        cut = n - n // 4
        edited = self.text[:cut] + following.text[: n // 4]
        hashes = PrefixHashes(np.concatenate([self.hashes.points[:cut], following.hashes.points[: n // 4]]), self.hashes, cut)
        printed = fingerprint(hashes)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        common = common_extension(self.hashes, 0, hashes, 0)
        return self.doc_id, n, digest, self.print.text, printed.text, likeness(self.print, printed), likeness(self.print, following.print), common


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in order; the rows marked as tail open the next range and close this one."""
    held, at, closed = None, None, False
    for part in slices(batches):
        out = []
        for bucket, tail, doc_id, text in zip(part.column("_bucket").to_pylist(), part.column("_tail").to_pylist(), part.column("doc_id").to_pylist(), texts(part.column("text")), strict=True):
            if bucket != at:
                held, at, closed = None, bucket, False
            if closed:
                continue
            document = _Document(doc_id, text)
            if held is not None:
                out.append(held.row(document))
            held, closed = document, tail
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the last quarter replaced by the start of the next document's.

    The next document is the one after it by ascending id (after the last: the first; a single
    document follows itself). Rows with equal ids stand in the order of their texts, rows without an
    id after all others. Null texts are empty: n_chars 0. Empty tables give no rows. Other columns of
    docs are not read.

    Ranges of ids are cut at ids of the table, so only the rows at a range's start are needed twice:
    the text moves once. An id (or none) that fills several ranges is cut by the first bytes of its texts
    as well; rows whose ids and first bytes are the same are in one range and pass as a stream.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_order"), part.alias("_part"))
    count = rows.count()
    ranges = min(max(MIN_RANGES, count // RANGE_ROWS), MAX_RANGES, max(1, count))
    shared = docs.sparkSession.sparkContext.broadcast(_bounds(rows, ranges))

    @F.pandas_udf("array<struct<bucket:int,tail:boolean>>")
    def places(order: pd.Series, part: pd.Series) -> pd.Series:
        cut_ids, cut_parts = shared.value
        ids, parts = order.to_numpy(), part.to_numpy()
        own = np.searchsorted(cut_ids, ids, "right") - 1
        for hot in np.unique(ids[(cut_ids[own] == ids) & (cut_parts[own] >= 0)]):
            low, high = np.searchsorted(cut_ids, hot, "left"), np.searchsorted(cut_ids, hot, "right")
            which = ids == hot
            own[which] = low + np.searchsorted(cut_parts[low:high], parts[which], "right") - 1
        first = (cut_ids[own] == ids) & ((cut_parts[own] < 0) | (cut_parts[own] == parts))
        return pd.Series([[{"bucket": b, "tail": False}] + [{"bucket": (b - 1) % len(cut_ids), "tail": True}] * f for b, f in zip(own.tolist(), first.tolist(), strict=True)])

    placed = rows.withColumn("_place", F.explode(places("_order", "_part"))).select(F.col("_place.bucket").alias("_bucket"), F.col("_place.tail").alias("_tail"), "_order", "doc_id", "text")
    tasks = count // RANGE_ROWS
    dealt = placed.repartition(tasks, "_bucket") if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else placed.repartition("_bucket")
    return dealt.sortWithinPartitions("_bucket", "_tail", "_order", "text").select("_bucket", "_tail", "doc_id", "text").mapInArrow(_neighbours, SCHEMA)


def _cuts(column: str, n: int):
    return F.expr(f"percentile_approx({column}, array({', '.join(f'{i / n}D' for i in range(n))}), {max(10_000, 10 * n)})")


def _bounds(rows: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges start: ids of the table, and the first bytes of texts as a number for ids that fill HOT_RANGES ranges or more (-1 for others). A few numbers a range reach the driver."""
    near, often = np.unique(np.array(rows.select(_cuts("_order", ranges)).first()[0] or [], np.int64), return_counts=True)
    if not len(near):
        return np.empty(0, np.int64), np.empty(0, np.int64)

    @F.pandas_udf("int")
    def bucket(order: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(near, order.to_numpy(), "right") - 1, 0))

    # percentiles are doubles, which are no exact ids above 2**53, so the least id from each on is looked up
    least = {r["bucket"]: r["least"] for r in rows.groupBy(bucket("_order").alias("bucket")).agg(F.min("_order").alias("least")).collect()}
    filled = {least[k]: int(often[k]) for k in least}
    cuts = {(i, -1) for i, n in filled.items() if n < HOT_RANGES}
    steps = {i: math.ceil(math.log2(n)) for i, n in filled.items() if n >= HOT_RANGES}
    for step in set(steps.values()):
        hot = rows.filter(F.col("_order").isin([i for i in steps if steps[i] == step]))
        for row in hot.groupBy("_order").agg(_cuts("_part", 1 << step).alias("parts"), F.min("_part").alias("least")).collect():
            cuts |= {(row["_order"], p) for p in {*row["parts"], row["least"]}}
    ordered = sorted(cuts)
    return np.array([i for i, _ in ordered], np.int64), np.array([p for _, p in ordered], np.int64)
