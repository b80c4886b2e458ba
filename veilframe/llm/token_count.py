"""Token counts by heap-and-linked-list byte-pair merging.

A piece's symbols form a linked list; a heap gives the adjacent pair of the lowest rank, leftmost
first. The count is the number of symbols less the number of merges: no identifiers are put out.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import slices, texts

#: How byte-level vocabularies cut text into pieces (fixed values).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Counts that a worker remembers, of words and of pieces; at the limit it starts anew.
REMEMBERED = 600_000

_wide = re.compile(r"\s\s|\s\Z")
_built: dict[str, TokenCounter] = {}


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def _check(read: dict[str, Any]) -> None:
    """Raises for what TokenCounter does not do: texts changed first, other pieces, other merges, special strings that take in what stands around them."""
    model, cut = read["model"], read.get("pre_tokenizer") or {}
    plain = {
        "model": model.get("type", "BPE") == "BPE",
        "normalizer": read.get("normalizer") is None,
        "pre_tokenizer": cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True),
        "merges": not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": not any(t.get(k) for t in read.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
        "truncation": read.get("truncation") is None and read.get("padding") is None,
    }
    if not all(plain.values()):
        raise ValueError("vocabulary not supported: " + ", ".join(k for k, good in plain.items() if not good))


class _Remembered(dict):
    def __init__(self, count: Any):
        super().__init__()
        self.count = count

    def __missing__(self, key: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.count(key)
        return value


class TokenCounter:
    """Counts as the tokenizers library does for a byte-level .json vocabulary without added begin or end tokens.

    Vocabularies that cut or merge in another way are refused: ValueError.
    """

    def __init__(self, description: str):
        read = json.loads(description)
        _check(read)
        vocab = read["model"]["vocab"]
        self.byte = [vocab[s] for _, s in sorted(byte_symbols().items())]
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(read["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] << 32 | vocab[right]] = (rank, vocab[left + right])
        special = [t["content"] for t in read.get("added_tokens", []) if t["content"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cut = regex.compile(PIECES)
        self.pieces = _Remembered(lambda piece: self.merged(piece.encode("utf-8", "surrogatepass")))
        self.words = _Remembered(lambda word: sum(map(self.pieces.__getitem__, self.cut.findall(" " + word))))

    def merged(self, data: bytes) -> int:
        """Symbols left of one piece after all merges."""
        n = len(data)
        if n < 2:
            return n
        ranks, symbols = self.ranks.get, [self.byte[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [ranks(symbols[i] << 32 | symbols[i + 1]) for i in range(n - 1)]  # of each symbol and its neighbour: rank and merged symbol
        waiting.append(None)
        heap = [pair[0] << 32 | i for i, pair in enumerate(waiting) if pair]
        heapq.heapify(heap)
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            pair = waiting[i]
            if pair is None or pair[0] != top >> 32:  # it has changed since
                continue
            merges += 1
            own = symbols[i] = pair[1]
            j = after[i]
            waiting[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = waiting[i] = ranks(own << 32 | symbols[k])
                if pair:
                    push(heap, pair[0] << 32 | i)
            else:
                waiting[i] = None
            h = before[i]
            if h >= 0:
                pair = waiting[h] = ranks(symbols[h] << 32 | own)
                if pair:
                    push(heap, pair[0] << 32 | h)
        return n - merges

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if _wide.search(text):  # white space of several characters can reach over a space
            return sum(map(self.pieces.__getitem__, self.cut.findall(text)))
        first, *words = text.split(" ")  # else each space begins a piece
        return sum(map(self.words.__getitem__, words)) + sum(map(self.pieces.__getitem__, self.cut.findall(first)))

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one token."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    vocabulary: path of a byte-level .json vocabulary on the driver; it is read there and sent to the
    tasks. Null texts count as empty: 0 tokens. Repeated rows give repeated results; empty tables none.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _built.get(key)
        if counter is None:
            _built.clear()
            counter = _built[key] = TokenCounter(shared.value)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array([counter.count(t) for t in texts(part.column("text"))], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
