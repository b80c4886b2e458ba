"""Fill-in-middle transformation by an index of distinct texts.

Rows are dealt out by a hash of their text, so that identical texts meet; each distinct text, told
apart by its content, gets one Elias-Fano list of the byte offsets at which its code points begin.
Every document is then joined to its text's list and cut at two seeded code points by selecting
from the list: no cut decodes or counts the text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import HOT_KEYS, slices, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares, in percent, of documents left plain, and of those cut that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: A text shared by more rows than this, and by more than 1 / HOT_KEYS of all rows, is dealt over several tasks.
GROUP_ROWS = 100
#: Bytes of outputs that are handed on together.
BATCH_BYTES = 1 << 23
_BLOCK = 64


class BoundaryList:
    """Elias-Fano code of a rising list of numbers: low bits packed, high bits in unary with ranks of every 64 bytes.

    Takes 2 + log2(last / size) bits a number, rounded up.
    """

    def __init__(self, numbers: np.ndarray):
        self.size = len(numbers)
        last = int(numbers[-1]) if self.size else 0
        self.low_bits = max(0, (last // max(self.size, 1)).bit_length() - 1)
        high = (numbers >> self.low_bits) + np.arange(self.size)
        bits = np.zeros((int(high[-1]) // (8 * _BLOCK) + 1) * 8 * _BLOCK if self.size else 0, np.uint8)
        bits[high] = 1
        self.high = np.packbits(bits)
        self.ranks = np.cumsum(bits.reshape(-1, 8 * _BLOCK).sum(1, dtype=np.int64)) if self.size else np.zeros(0, np.int64)
        low = (numbers[:, None] >> np.arange(self.low_bits)) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel())

    def select(self, k: int) -> int:
        """The number at place k, from 0."""
        if not 0 <= k < self.size:
            raise IndexError(k)
        block = int(np.searchsorted(self.ranks, k, "right"))
        before = int(self.ranks[block - 1]) if block else 0
        ones = np.flatnonzero(np.unpackbits(self.high[block * _BLOCK : (block + 1) * _BLOCK]))
        high = block * 8 * _BLOCK + int(ones[k - before]) - k
        low, start = 0, k * self.low_bits
        for bit in range(self.low_bits):
            at = start + bit
            low |= (int(self.low[at >> 3]) >> (7 - (at & 7)) & 1) << bit
        return high << self.low_bits | low


def boundaries(data: bytes) -> BoundaryList:
    """Where the code points of UTF-8 begin, and where the last one ends."""
    begins = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
    return BoundaryList(np.append(begins, len(data)))


def seeded(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four groups of eight hex digits of the sha256 of seed:doc_id (a null id is empty)."""
    data = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(data[k : k + 4], "big") for k in range(0, 16, 4))  # type: ignore[return-value]


def cut(data: bytes, at: BoundaryList, doc_id: int | None, seed: int, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int | None, int | None, bytes]:
    """form, prefix_chars, middle_chars and output of one document."""
    n = at.size - 1
    h1, h2, h3, h4 = seeded(doc_id, seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not n or h3 % 100 >= 100 - plain or any(m in data for m in marks):
        return "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = at.select(low), at.select(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < suffix_first:
        return "spm", low, high - low, marks[1] + suffix + marks[0] + prefix + marks[2] + middle
    return "psm", low, high - low, marks[0] + prefix + marks[1] + suffix + marks[2] + middle


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (code points), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output of every row.

    Null texts are empty, and empty texts plain, as are those that hold a mark. Two rows of one id are
    cut by the same draws, each in its own text; a null id draws as the empty one. Columns of docs
    besides id and text are not read, so their names can't clash. Empty tables give none.
    Texts move once; a text that many rows share is dealt over tasks by their ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    bound = max(GROUP_ROWS, docs.count() // HOT_KEYS)
    # more than bound rows each, so HOT_KEYS rows at most
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound).select("key", F.ceil(F.col("n") / bound).alias("parts"))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.col("parts"))).otherwise(F.lit(0))
    dealt = rows.join(F.broadcast(hot), "key", "left").select("key", part.alias("part"), "doc_id", "text").repartition("key", "part").sortWithinPartitions("key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index = None, {}
        held, size = [], 0
        for batch in slices(batches):
            for own, doc_id, text in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                if own != key:
                    key, index = own, {}
                found = index.get(text)  # compares whole texts: equal hashes alone join nothing
                if found is None:
                    data = text.encode()
                    found = index[text] = data, boundaries(data)
                data, at = found
                form, before, middle, output = cut(data, at, doc_id, seed, plain, suffix_first)
                held.append((doc_id, at.size - 1, form, before, middle, output.decode()))
                size += len(output)
                if size >= BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    return dealt.select("key", "doc_id", "text").mapInArrow(run, _OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. A mark can't arise where two parts meet, as marks begin with their only `<`."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    whole = F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
    return F.when(form == "plain", output).otherwise(F.coalesce(whole, F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))))
