"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 3 to 0 with symbol counts. A text's code length
under a tree is exact PPM (method C escapes, exclusion of symbols already refused) under frozen
counts; the language with the shortest code wins. With frozen counts the length of a byte depends
only on it and the three before it, so lengths are tabled per four-byte string.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import held_out, slices, texts

ORDER = 3
#: What stands before a text's first byte.
START = b"\n" * ORDER
#: Labelled documents per language that the trees are counted from (expected number, chosen by a hash of the id).
TRAIN_DOCS = 400
GROUP_CHARS = 1 << 17
_letter = regex.compile(r"\p{L}")  # numbers that are no digits and marks are no letters


def windows(text: str) -> np.ndarray:
    """uint32 of each byte with the three before it."""
    data = np.frombuffer(START + text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys in a sorted table, and which are there."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class ContextTree:
    """Symbol counts of one language by context, from the counts of four-byte strings."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.grams, self.contexts = [], []
        for order in range(ORDER + 1):
            own = keys.astype(np.uint64) & np.uint64((1 << 8 * (order + 1)) - 1)
            grams, where = np.unique(own, return_inverse=True)
            number = np.bincount(where, counts, len(grams))
            contexts, start = np.unique(grams >> np.uint64(8), return_index=True)
            total = np.add.reduceat(number, start) if len(grams) else number
            kinds = np.diff([*start, len(grams)]).astype(float) if len(grams) else number
            #: What the symbols seen in a context count for in the context one byte shorter.
            excluded = np.zeros(len(contexts))
            if order and len(grams):
                at, _ = _find(self.grams[-1][0], grams & np.uint64((1 << 8 * order) - 1))
                excluded = np.add.reduceat(self.grams[-1][1][at], start)
            self.grams.append((grams, number))
            self.contexts.append((contexts, total, kinds, excluded))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each four-byte string's last byte after the first three."""
        keys = keys.astype(np.uint64)
        n = len(keys)
        out, todo = np.zeros(n), np.ones(n, bool)
        less, fewer = np.zeros(n), np.zeros(n)  # counts and kinds of symbols already refused
        for order in range(ORDER, -1, -1):
            contexts, total, kinds, excluded = self.contexts[order]
            gram = keys & np.uint64((1 << 8 * (order + 1)) - 1)
            at, seen = _find(contexts, gram >> np.uint64(8))
            seen &= todo
            if not seen.any():
                continue
            at = at[seen]
            left, kinds_left = total[at] - less[seen], kinds[at] - fewer[seen]
            where, hit = _find(self.grams[order][0], gram[seen])
            whole = left + kinds_left
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.where(hit, -np.log2(self.grams[order][1][where] / whole), np.where(kinds_left > 0, -np.log2(kinds_left / whole), 0.0))
            out[seen] += cost
            less[seen], fewer[seen] = excluded[at], kinds[at]
            done = np.flatnonzero(seen)[hit]
            todo[done] = False
        out[todo] += np.log2(np.maximum(256 - fewer[todo], 1))
        return out


class Model:
    """The trees of all languages, with the code lengths of every four-byte string seen in training in one hash table."""

    def __init__(self, languages: list[str], trees: list[ContextTree], keys: np.ndarray):
        self.languages, self.trees = languages, trees
        keys = np.unique(keys.astype(np.uint32))
        self.bits = [np.append(t.bits(keys), 0.0) for t in trees]
        self.shift = 32 - max(4, int(4 * len(keys) + 1).bit_length())
        size = 1 << (32 - self.shift)
        self.key, self.row = np.zeros(size, np.uint32), np.full(size, -1, np.int32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):  # each round the first of those that want a free slot gets it, the others move on by one
            free = self.row[slot[rest]] < 0
            want, first = np.unique(slot[rest[free]], return_index=True)
            taken = rest[free][first]
            self.key[want], self.row[want] = keys[taken], taken
            rest = np.setdiff1d(rest, taken, assume_unique=True)
            slot[rest] = (slot[rest] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(self.shift)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Row of each string's lengths; -1 for strings not seen in training."""
        slot = self._slot(keys)
        rows = self.row[slot]
        wrong = np.flatnonzero((self.key[slot] != keys) & (rows >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % len(self.key)
            rows[wrong] = self.row[slot[wrong]]
            wrong = wrong[(self.key[slot[wrong]] != keys[wrong]) & (rows[wrong] >= 0)]
        return rows

    def code_lengths(self, many: list[str]) -> np.ndarray:
        """Bits that each language's tree takes for each text: texts by languages."""
        keys = [windows(t) for t in many]
        sizes = np.array([len(k) for k in keys])
        out = np.zeros((len(many), len(self.trees)))
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        joined = np.concatenate(keys)
        rows = self.lookup(joined)
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(len(self.trees)):
            out[full, k] = np.add.reduceat(self.bits[k][rows], starts)  # row -1, of strings not seen, is 0
        unseen = np.flatnonzero(rows < 0)
        if len(unseen):
            rare, where = np.unique(joined[unseen], return_inverse=True)
            owner = np.repeat(np.arange(len(many)), sizes)[unseen]
            for k, tree in enumerate(self.trees):
                out[:, k] += np.bincount(owner, tree.bits(rare)[where], len(many))
        return out

    def predict(self, many: list[str]) -> list[tuple[str, float, float]]:
        """Language, confidence and bits per byte of each text; 'und' for texts without a letter."""
        found: list[tuple[str, float, float]] = []
        lengths = self.code_lengths(many)
        for text, own in zip(many, lengths, strict=True):
            if not self.trees or not _letter.search(text):
                found.append(("und", 0.0, 0.0))
                continue
            best = int(own.argmin())
            size = len(text.encode("utf-8", "surrogatepass"))
            ratio = np.exp2(-(own - own[best]) / size**0.5)
            found.append((self.languages[best], float(1 / ratio.sum()), float(own[best] / size)))
        return found


def _groups(many: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about GROUP_CHARS, so that their lengths are looked up together in bounded memory."""
    held, size = [], 0
    for text in many:
        held.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 64):
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), texts(part.column("text")), strict=True):
            by.setdefault(lang, []).append(windows(text))
        for lang, found in by.items():
            keys, number = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(number.astype(np.int64))], ["lang", "key", "n"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Counts the trees from about train_docs documents of each language, chosen by a hash of the id. Rows without language or text teach nothing."""
    usable = labelled.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return Model([], [], np.empty(0, np.uint32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_docs / n))])[F.col("lang")]
    at = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    counts = usable.filter(at < share).select("lang", "text").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    trees = [ContextTree(own["key"].to_numpy(np.uint64), own["n"].to_numpy(float)) for own in (counts[counts["lang"] == lang] for lang in languages)]
    return Model(languages, trees, counts["key"].to_numpy())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), bits_per_byte of every row.

    'und' with score 0 for null texts, texts without a letter (Unicode's: neither ½ nor Ⅳ nor a mark alone is one), and any text if the model has no
    language. Ties go to the language that sorts first. Repeated rows give repeated results; empty
    tables none.
    """
    shared: Any = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches):
            found = [x for group in _groups(texts(part.column("text"))) for x in own.predict(group)]
            lang, score, rate = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang), pa.array(score), pa.array(rate)], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")
