"""Packed token matrices by best-fit decreasing.

Documents become token ids; what is longer than a row is split without loss into full rows and a
rest; the rests, longest first, go to the row with the least space that still holds them, found in a
segment tree over capacities. Each partition packs its own documents in blocks of bounded size.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import slices, texts

SEQUENCE = 1024
#: Tokens that a task holds and packs together.
BLOCK_TOKENS = 4_000_000
#: Ids of words that a worker remembers; at the limit it starts anew.
REMEMBERED = 600_000
#: How byte-level vocabularies cut text into pieces (fixed values). The second form says the same for texts without runs of white space.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES_PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""

_wide = re.compile(r"\s\s|\s\Z")
_built: dict[str, Tokens] = {}


class Tokens:
    """Token ids of ordinary text (special strings are text too) from a rank file."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.size = len(table)
        self.kind = np.dtype("<u2" if self.size < 1 << 16 else "<u4")
        self.full = tiktoken.Encoding("full", pat_str=PIECES, mergeable_ranks=table, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=PIECES_PLAIN, mergeable_ranks=table, special_tokens={})
        self.opens = np.zeros(self.size, bool)  # tokens that begin with a space
        self.opens[[rank for token, rank in table.items() if token[:1] == b" "]] = True
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        if _wide.search(text):
            return np.array(self.full.encode_ordinary(text), self.kind)
        first, *words = text.split(" ")  # else each space begins a piece, and no other token begins with a space
        found = list(map(self.words.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, ids in zip(words, found, strict=True) if ids is None))
            ids = np.array(self.plain.encode_ordinary(" " + " ".join(new)), self.kind)
            starts = np.flatnonzero(self.opens[ids]) * self.kind.itemsize
            data = ids.tobytes()
            if len(self.words) + len(new) > REMEMBERED:
                self.words.clear()
            own = {w: data[a:b] for w, a, b in zip(new, starts.tolist(), [*starts[1:].tolist(), len(data)], strict=True)}
            self.words.update(own)
            found = [own[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        head = np.array(self.plain.encode_ordinary(first), self.kind).tobytes()
        return np.frombuffer(head + b"".join(found), self.kind)

    def decode(self, ids: np.ndarray) -> str:
        return self.full.decode(ids.tolist(), errors="strict")


class Capacities:
    """Segment tree over the capacities 0..most: which is the least one, at or above a size, that a row has?"""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, row) of the best fit, taken out; None if no row has the space."""
        node = size + self.leaves
        if not self.count[node]:
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):  # up to where something lies to the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit(sizes: list[int], most: int) -> list[list[int]]:
    """Members of each row; every size is at most `most`. Longest first, equal sizes in the given order."""
    free, rows = Capacities(most), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = free.take(sizes[k])
        if found is None:
            found = most, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(k)
        free.add(capacity - sizes[k], row)
    return rows


SCHEMA = "pack_id string, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"
_ARROW = pa.schema([
    ("pack_id", pa.string()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
    ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())),
])


def _pack(block: list[tuple[int | None, np.ndarray]], width: int, pad: int, kind: np.dtype, name: str) -> Iterator[pa.RecordBatch]:
    """Rows of one block of documents."""
    pieces = [(doc_id, start, ids[start : start + width]) for doc_id, ids in block for start in range(0, max(len(ids), 1), width)]
    steps = np.arange(width, dtype=np.uint32 if width > 1 << 16 else np.uint16).astype("<u4" if width > 1 << 16 else "<u2")
    rows = best_fit([len(p[2]) for p in pieces], width)
    for first in range(0, len(rows), 256):
        out = []
        for number, members in enumerate(rows[first : first + 256], first):
            own = [pieces[k] for k in members]
            ends = np.cumsum([0, *(len(p[2]) for p in own)])
            ids = np.full(width, pad, kind)
            ids[: ends[-1]] = np.concatenate([p[2] for p in own])
            positions = np.concatenate([*(steps[: len(p[2])] for p in own), steps[: width - ends[-1]] * 0])
            out.append((f"{name}-{number:06d}", int(ends[-1]), ids.tobytes(), positions.tobytes(), ends.tolist(), ends[:-1].tolist(), [p[0] for p in own], [p[1] for p in own]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def pack_documents(docs: DataFrame, vocabulary: str, width: int = SEQUENCE, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `width` token ids, filled with whole documents or parts of documents longer than a row.

    input_ids: width little-endian ids of 2 bytes (4 for vocabularies of 65,536 and more), padded with
    the id after the last one. position_ids: as many positions, from 0 in each segment (2 bytes, 4 for
    widths above 65,536). cu_seqlens: 0 and the end of each segment. position_resets: where positions
    start anew. doc_ids, doc_offsets: the document of each segment and the segment's first token in it.
    n_tokens: ids that aren't padding. pack_id: partition, block and row; the same for the same input
    partitions.

    Each token of each row of docs is in exactly one segment. Null and empty texts give a segment of
    length 0, so no row of docs is lost; repeated rows and null ids are kept as they are. Empty tables
    give no rows. vocabulary: path of a rank file on the driver, which sends it to the tasks.
    """
    if width < 1:
        raise ValueError("width must be positive")
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _built.get(key)
        if tokens is None:
            _built.clear()
            tokens = _built[key] = Tokens(shared.value)
        partition, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part.column("text")), strict=True):
                ids = tokens.encode(text)
                held.append((doc_id, ids))
                size += len(ids)
                if size >= block_tokens:
                    yield from _pack(held, width, tokens.size, tokens.kind, f"{partition:06d}-{number:04d}")
                    number, held, size = number + 1, [], 0
        if held:
            yield from _pack(held, width, tokens.size, tokens.kind, f"{partition:06d}-{number:04d}")

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of the documents of packed rows (ids must be distinct): the inverse of pack_documents."""
    with open(vocabulary, "rb") as file:
        shared = packed.sparkSession.sparkContext.broadcast(file.read())

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for part in slices(batches):
            out = []
            for row in part.to_pylist():
                ids = np.frombuffer(row["input_ids"], tokens.kind)
                ends = row["cu_seqlens"]
                out += [(d, o, ids[a:b].tobytes()) for d, o, a, b in zip(row["doc_ids"], row["doc_offsets"], ends, ends[1:], strict=False)]
            ids, offsets, data = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "at", "data"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for part in slices(batches):
            out = [tokens.decode(np.frombuffer(b"".join(d["data"] for d in parts), tokens.kind)) for parts in part.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    parts = packed.mapInArrow(segments, "doc_id long, at long, data binary").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("parts"))  # the parts of one document
    return parts.mapInArrow(joined, "doc_id long, text string")
