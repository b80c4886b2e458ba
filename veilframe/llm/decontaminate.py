"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits, cut into k + 1 pieces, has a piece that the
edits leave alone. All pieces of all items are looked for at once (Aho-Corasick); around each exact
hit Myers' bit-parallel distance tells whether the whole item is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import keep_rows, slices, texts

#: Edits allowed per character of an item; fewer if a piece would get shorter than LEAST_PIECE.
ERROR_RATE, LEAST_PIECE = 0.08, 14
#: Items of more text than this are matched block by block.
BLOCK_CHARS = 4_000_000

_built: dict[str, Matcher] = {}


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def budget(length: int, error_rate: float = ERROR_RATE, least_piece: int = LEAST_PIECE) -> int:
    return max(0, min(int(length * error_rate), length // least_piece - 1))


class Pattern:
    """An item as bit masks by character."""

    def __init__(self, text: str, errors: int):
        self.size, self.errors = len(text), errors
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str, start: int, end: int) -> tuple[int, int]:
        """Least edits between the item and a substring of text[start:end], and where the first such substring ends."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, edits = full, 0, self.size
        best, at = edits, start
        masks = self.masks
        for i in range(start, end):
            equal = masks.get(text[i], 0)
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & top:
                edits += 1
            elif down & top:
                edits -= 1
                if edits < best:
                    best, at = edits, i + 1
            up, down = up << 1, down << 1
            plus = (down | ~(vertical | up)) & full
            minus = up & vertical & full
        return best, at


class Matcher:
    """All items of a block, by piece."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, least_piece: int):
        self.items: list[tuple[int, Pattern]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            size = len(text)
            if not size:
                continue
            errors = budget(size, error_rate, least_piece)
            for k in range(errors + 1):
                begin, end = size * k // (errors + 1), size * (k + 1) // (errors + 1)
                places.setdefault(text[begin:end], []).append((len(self.items), begin))
            self.items.append((item_id, Pattern(text, errors)))
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, (len(piece), where))
        if places:
            self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, least edits, end of the first best match in the normalised text) of every item in the text, in the order of their first pieces."""
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (length, where) in self.pieces.iter(text):
            for item, begin in where:
                pattern = self.items[item][1]
                start = last + 1 - length - begin - pattern.errors
                end = start + pattern.size + 2 * pattern.errors
                own = windows.setdefault(item, [])
                if own and start <= own[-1][1] and end >= own[-1][0]:
                    own[-1][0], own[-1][1] = min(own[-1][0], start), max(own[-1][1], end)
                else:
                    own.append([start, end])
        found = []
        for item, own in windows.items():
            item_id, pattern = self.items[item]
            best, at = min(pattern.search(text, max(0, start), min(len(text), end)) for start, end in own)
            if best <= pattern.errors:
                found.append((item_id, best, at))
        return found


def _blocks(benchmark: DataFrame, item_id_col: str, item_text_col: str, error_rate: float, least_piece: int) -> list[Callable[[], Matcher]]:
    """For each block of items what gives a task its matcher; a worker builds it once."""
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))

    def block(number: int) -> Callable[[], Matcher]:
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        shared = benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], normalise(r["text"])) for r in own.collect()])  # about BLOCK_CHARS characters
        key = uuid.uuid4().hex

        def matcher() -> Matcher:
            if key not in _built:
                while len(_built) >= 2:
                    _built.pop(next(iter(_built)))
                _built[key] = Matcher(shared.value, error_rate, least_piece)
            return _built[key]

        return matcher

    return [block(k) for k in range(blocks)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, least_piece: int = LEAST_PIECE) -> DataFrame:
    """doc_id, item_id, edits, match_end of every item that a document holds with at most budget() edits.

    Texts are compared in lower case with runs of white space as one space; match_end counts
    characters of that form. One row per row of docs and item: the fewest edits, the first place.
    Null and empty texts hold nothing; null and empty items are held by nothing. Repeated rows give
    repeated results, items with equal texts a row each. An empty table on either side gives no rows.

    The items are the query set: they are measured first, and go to the tasks in blocks of about
    BLOCK_CHARS characters, each block against all rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def against(block: Callable[[], Matcher]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = block()
            for part in slices(batches):
                found = [(doc_id, *hit) for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part.column("text")), strict=True) for hit in matcher.find(normalise(text))]
                if found:
                    ids, items, edits, ends = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(edits, pa.int32()), pa.array(ends, pa.int64())], ["doc_id", "item_id", "edits", "match_end"])

        return rows.mapInArrow(run, "doc_id long, item_id long, edits int, match_end long")

    return reduce(DataFrame.unionByName, map(against, _blocks(benchmark, item_id_col, item_text_col, error_rate, least_piece)))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, least_piece: int = LEAST_PIECE) -> DataFrame:
    """The rows of docs that hold no item, all columns as they are."""

    def apart(rows: DataFrame, block: Callable[[], Matcher]) -> DataFrame:
        return keep_rows(rows, [text_col], lambda batch: [not block().find(normalise(t)) for t in texts(batch.column(0))])

    return reduce(apart, _blocks(benchmark, item_id_col, item_text_col, error_rate, least_piece), docs)
