"""Alignment of the tokens of two vocabularies.

Python only tokenises. Both vocabularies cut a text at each space that follows a character which isn't
white space, so a text is a list of words and the words of about a thousand texts are tokenised, and
aligned, once. From there on Spark's higher-order functions work: array_intersect of the end arrays
gives the byte offsets where tokens of both end, these cut the tokens into groups, and all pairs of
a group's tokens are links. Counts of linked id pairs over the corpus are joined back to documents.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import if_small, join_groups, texts, written
from veilframe.llm.token_count import PIECES, byte_symbols
from veilframe.llm.token_count import _check as check_byte_level

SPACE = "▁"
#: Code points and rows of the texts whose words are aligned together: a word is aligned once a group, and four times the text has about twice the distinct words.
GROUP_CHARS, GROUP_ROWS = 1 << 21, 4096
#: Words, and code points in them, that a worker remembers the tokens of; beyond either only those stay that several groups had.
REMEMBERED, REMEMBERED_CHARS = 250_000, 1 << 23
#: Words that are tokenised together, and texts that are cut into words together.
LEARN_BLOCK, CUT_TEXTS = 1024, 64
#: Texts that Spark sends to a worker at once: its usual 10,000 are some 30 MB, which both sides hold.
SENT_ROWS = 512
#: How the alignment is written: a row is some MB, and Spark's reader takes up to 4096 rows at once if a row group has them.
ROW_BY_ROW = {"parquet.block.row.count.limit": 1}
#: Counts of id pairs up to this number (about 40 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
#: Tokens of a word in which a place is looked up by going through them.
SHORT_WORD = 32
#: A link is one number: A's id times this, plus B's id.
PAIR = 1 << 32

_built: dict[str, Any] = {}
_breaks = re.compile(r"\s ")
_GROUP = "batch long, docs array<struct<doc_id:long,n_a:long,n_b:long,refs:array<int>>>, words array<struct<a:array<int>,a_ends:array<int>,b:array<int>,b_ends:array<int>>>"


def words(text: str) -> list[str]:
    """The text, with a space put before it, cut at each space that follows a character which isn't white space; without the space that begins each word.

    No piece of either vocabulary reaches over such a place.
    """
    parts = text.split(" ")
    if not _breaks.search(f" {text}"):
        return parts
    made: list[list[str]] = []
    last = " "
    for part in parts:
        if made and last.isspace():
            made[-1].append(part)
        else:
            made.append([part])
        last = part[-1] if part else " "
    return [" ".join(m) for m in made]


def check_pieces(model: bytes) -> None:
    """Raises for a piece vocabulary that changes texts first, adds no space, or has pieces that go on over a space."""
    from sentencepiece import sentencepiece_model_pb2

    read = sentencepiece_model_pb2.ModelProto()
    read.ParseFromString(model)
    norm = read.normalizer_spec
    plain = {
        "normalizer": not norm.precompiled_charsmap and not norm.remove_extra_whitespaces,
        "spaces": norm.add_dummy_prefix and norm.escape_whitespaces and not read.trainer_spec.treat_whitespace_as_suffix,
        "pieces": not any(SPACE in p.piece.lstrip(SPACE) or " " in p.piece for p in read.pieces),
        "byte_fallback": read.trainer_spec.byte_fallback,
    }
    if not all(plain.values()):
        raise ValueError("vocabulary not supported: " + ", ".join(k for k, good in plain.items() if not good))


class _Places(dict):
    """A number for each word, given when it is first asked for; words that got one since are in `new`."""

    def __init__(self, words: Iterable[str] = ()):
        super().__init__((w, k) for k, w in enumerate(words))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = place = len(self)
        return place


class Encoder:
    """Tokens of words under both vocabularies: ids, and where each ends in the bytes of the word and the space before it."""

    def __init__(self, description: str, model: bytes):
        import sentencepiece
        import tiktoken

        read = json.loads(description)["model"]
        byte = {s: b for b, s in byte_symbols().items()}
        ranks = {bytes(byte[c] for c in s): i for s, i in read["vocab"].items() if all(c in byte for c in s)}
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in read["merges"]]
        first = len(byte)
        if any(read["vocab"][s] >= first for s in byte) or [read["vocab"][s] for s in made] != list(range(first, first + len(made))):
            raise ValueError("vocabulary not supported: ids not in the order of merges")
        # where ids follow the merges, merging by rank gives the tokens of the description's own library
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks={s: i for s, i in ranks.items() if i < first + len(made)}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes: tuple[list[bytes], list[bytes]] = [b""] * (first + len(made)), [self._piece(k) for k in range(self.b.get_piece_size())]
        for s, i in ranks.items():
            if i < len(self.bytes[0]):
                self.bytes[0][i] = s
        self.sizes = tuple(np.array([len(x) for x in own], np.int64) for own in self.bytes)
        self.only_space = self.b.piece_to_id(SPACE)
        self._forget()

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace(SPACE, " ").encode()

    def _forget(self) -> None:
        self.places = _Places()
        self.chars = 0
        self.good = bytearray()
        #: In how many groups a word was, since it was kept last.
        self.groups = np.zeros(0, np.int32)
        #: Of each vocabulary: ids and ends of all words one after another, and where each word's begin.
        self.ids, self.ends, self.starts = (array("i"), array("i")), (array("i"), array("i")), (array("q", [0]), array("q", [0]))

    def _tokens(self, text: str) -> tuple[list[int], list[int]]:
        return self.a.encode_ordinary(f" {text}"), self.b.encode(text, num_threads=1) if text else [self.only_space]

    def _learn(self, new: list[str]) -> None:
        """The words, joined by spaces, are tokenised together; alone those that this could give other tokens, or that a vocabulary changes."""
        odd = [k for k, w in enumerate(new) if not w or w[-1].isspace()]
        if odd and len(new) > 1:
            for start, k in zip([0, *[k + 1 for k in odd]], [*odd, len(new)], strict=True):
                for part in (new[start:k], new[k : k + 1]):
                    if part:
                        self._learn(part)
            return
        text = " ".join(new)
        sizes = np.array([len(w.encode()) for w in new] if len(text) < len(text.encode()) else [len(w) for w in new]) + 1
        whole, ends = f" {text}".encode(), np.cumsum(sizes)
        tokens = self._tokens(text)
        reached = [np.cumsum(self.sizes[side][tokens[side]]) for side in (0, 1)]
        good = all(b"".join(map(self.bytes[side].__getitem__, tokens[side])) == whole for side in (0, 1))
        if len(new) > 1 and not good:
            for part in (new[: len(new) // 2], new[len(new) // 2 :]):
                self._learn(part)
            return
        self.good.extend([good] * len(new))
        for side in (0, 1):
            until = np.searchsorted(reached[side], ends) + 1 if good else np.array([len(tokens[side])])
            counts = np.diff(until, prepend=0)
            self.ids[side].extend(tokens[side])
            self.ends[side].frombytes((reached[side] - np.repeat(ends - sizes, counts)).astype(np.int32).tobytes())
            self.starts[side].frombytes((until + self.starts[side][-1]).astype(np.int64).tobytes())

    def _too_much(self) -> bool:
        return len(self.places) > REMEMBERED or self.chars > REMEMBERED_CHARS

    def begin(self) -> None:
        """Before each group: what is remembered stays, unless it is too much."""
        if self._too_much():
            self._keep(np.flatnonzero(self.groups > 1))
            if self._too_much():
                self._forget()

    def _keep(self, codes: np.ndarray) -> None:
        """Remembers only these words (ascending numbers), under new numbers."""
        every = list(self.places)
        words = [every[k] for k in codes.tolist()]
        lists = [self.tokens(side, codes) for side in (0, 1)]
        good = bytes(np.frombuffer(self.good, np.uint8)[codes])
        self._forget()
        self.places, self.chars = _Places(words), sum(map(len, words))
        self.good.extend(good)
        self.groups = np.zeros(len(words), np.int32)
        for side in (0, 1):
            ids, ends = lists[side]
            self.ids[side].frombytes(ids.values.to_numpy().tobytes())
            self.ends[side].frombytes(ends.values.to_numpy().tobytes())
            self.starts[side].frombytes(ids.offsets.to_numpy()[1:].astype(np.int64).tobytes())

    def count(self, codes: np.ndarray) -> None:
        """After each group: these are its distinct words."""
        self.groups = np.append(self.groups, np.zeros(len(self.places) - len(self.groups), np.int32))
        self.groups[codes] += 1

    def codes(self, cut: list[list[str]]) -> list[np.ndarray]:
        """A number for each word of each text, which holds until the next begin(); words not seen before are tokenised in blocks."""
        places = self.places
        found = [np.fromiter(map(places.__getitem__, one), np.int64, len(one)) for one in cut]
        new, places.new = places.new, []
        self.chars += sum(map(len, new))
        for start in range(0, len(new), LEARN_BLOCK):
            self._learn(new[start : start + LEARN_BLOCK])
        return found

    def tokens(self, side: int, codes: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Lists of ids and of ends, a list for each word."""
        starts = np.frombuffer(self.starts[side], np.int64)
        counts = starts[codes + 1] - starts[codes]
        offsets = np.append(0, np.cumsum(counts))
        at = np.repeat(starts[codes] - offsets[:-1], counts) + np.arange(offsets[-1])
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, np.int32)[at] if len(at) else np.zeros(0, np.int32))) for values in (self.ids[side], self.ends[side])]
        return lists[0], lists[1]


def _group(encoder: Encoder, number: int, ids: list[int | None], many: list[str]) -> pa.RecordBatch:
    """One row: the texts as lists of places among their distinct words, and these words' tokens."""
    encoder.begin()
    found = [c for k in range(0, len(many), CUT_TEXTS) for c in encoder.codes([words(t) if t else [] for t in many[k : k + CUT_TEXTS]])]
    good = np.frombuffer(encoder.good, np.uint8) if encoder.good else np.zeros(0, np.uint8)
    found = [c if good[c].all() else c[:0] for c in found]
    flat = np.concatenate(found)
    used = np.zeros(len(encoder.places), bool)
    used[flat] = True
    distinct, refs = np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - 1)[flat]
    encoder.count(distinct)
    offsets = np.append(0, np.cumsum([len(c) for c in found]))

    def total(side: int) -> np.ndarray:
        starts = np.frombuffer(encoder.starts[side], np.int64)
        return np.diff(np.append(0, np.cumsum(starts[flat + 1] - starts[flat]))[offsets])

    docs = pa.StructArray.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(total(0), pa.int64()), pa.array(total(1), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(refs))], ["doc_id", "n_a", "n_b", "refs"]
    )
    table = pa.StructArray.from_arrays([*encoder.tokens(0, distinct), *encoder.tokens(1, distinct)], ["a", "a_ends", "b", "b_ends"])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(docs), one(table)], ["batch", "docs", "words"])


def _encoder(vocabularies: str, query: str, read: Callable[[], tuple[str, bytes]]) -> Encoder:
    """The worker's encoder of these vocabularies, built once; words are remembered for one query."""
    if _built.get("vocabularies") != vocabularies:
        _built.clear()
        _built.update(vocabularies=vocabularies, query=query, encoder=Encoder(*read()))
    elif _built["query"] != query:
        _built["encoder"]._forget()
        _built["query"] = query
    return _built["encoder"]


def tokenised(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of about a thousand texts each: batch (a number of its own), docs (doc_id, n_a, n_b, places of its words among the row's), words (a, a_ends, b, b_ends: ids, and the bytes of the word at which they end).

    byte_level, pieces: paths of a byte-level .json vocabulary and of a piece .model on the driver. Other
    kinds of vocabulary are refused: ValueError. Texts that are null, empty or change on the way through a
    vocabulary have no words.
    """
    with open(byte_level, encoding="utf-8") as file:
        description = file.read()
    check_byte_level(json.loads(description))
    with open(pieces, "rb") as file:
        model = file.read()
    check_pieces(model)
    shared = docs.sparkSession.sparkContext.broadcast((description, model))
    vocabularies, query = hashlib.sha256(description.encode() + model).hexdigest(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabularies, query, lambda: shared.value)
        number = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        many: list[str] = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part.column("text")), strict=True):
                    ids.append(doc_id)
                    many.append(text)
                    size += len(text)
                    if size >= GROUP_CHARS or len(ids) >= GROUP_ROWS:
                        yield _group(encoder, number, ids, many)
                        number, ids, many, size = number + 1, [], [], 0
        if ids:
            yield _group(encoder, number, ids, many)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _GROUP)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once: an aggregate over nothing, as a transform of one element would copy the whole result."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def _upto(own: Column, ends: Column) -> Column:
    """How many of a vocabulary's tokens end at or before each common end: looked up in short words; in long ones the ends are sorted among the vocabulary's own, and their places there less the common ends before them."""
    both = F.sort_array(F.concat(F.transform(own, lambda e: e * 2), F.transform(ends, lambda e: e * 2 + 1)))
    places = let(both, lambda m: F.filter(F.transform(m, lambda x, p: F.when(x % 2 == 1, p)), lambda p: p.isNotNull()))
    looked_up = F.transform(ends, lambda e: F.array_position(own, e).cast("int"))
    return F.when(F.size(own) <= SHORT_WORD, looked_up).otherwise(F.transform(places, lambda p, k: p - k))


def _pair(a: Column, b: Column) -> Column:
    return a * F.lit(PAIR) + b


def _in_groups(word: Column, at: Column) -> Column:
    """n_groups, links and line of a word whose groups end at tokens at["a"], at["b"].

    Most groups have one token of each vocabulary: these are read where they stand, only the others are cut out as lists.
    """
    text = lambda token: token.cast("string")

    def of_lists(g: Column) -> Column:
        ids = lambda side: F.array_join(side.cast("array<string>"), ",")
        every = F.flatten(F.transform(g["a"], lambda x: F.transform(g["b"], lambda y: _pair(x, y))))
        return F.struct(every.alias("links"), F.concat(ids(g["a"]), F.lit("|"), ids(g["b"])).alias("line"))

    def group(end_a: Column, k: Column) -> Column:
        ends = {"a": end_a, "b": F.get(at["b"], k)}
        begin = {side: F.coalesce(F.get(at[side], k - 1), F.lit(0)) for side in "ab"}
        counts = {side: ends[side] - begin[side] for side in "ab"}
        x, y = [F.get(word[side], ends[side] - 1) for side in "ab"]
        single = F.struct(F.array(_pair(x, y)).alias("links"), F.concat(text(x), F.lit("|"), text(y)).alias("line"))
        lists = F.struct(*[F.slice(word[side], begin[side] + 1, counts[side]).alias(side) for side in "ab"])
        return F.when((counts["a"] == 1) & (counts["b"] == 1), single).otherwise(let(lists, of_lists))

    made = lambda found: F.struct(F.size(found).alias("n_groups"), F.flatten(found["links"]).alias("links"), F.array_join(found["line"], ";").alias("line"))
    return let(F.transform(at["a"], group), made)


def aligned(word: Column) -> Column:
    """struct<n_groups, links array<long>, line> of a word's tokens (a, a_ends, b, b_ends); line has ids as a1,a2|b1 of each group, joined by ;."""

    def of(ends: Column) -> Column:
        return let(F.struct(_upto(word["a_ends"], ends).alias("a"), _upto(word["b_ends"], ends).alias("b")), lambda at: _in_groups(word, at))

    line = F.array_join(F.zip_with(word["a"], word["b"], lambda x, y: F.concat(x.cast("string"), F.lit("|"), y.cast("string"))), ";")
    one_to_one = F.struct(F.size(word["a"]).alias("n_groups"), F.zip_with(word["a"], word["b"], _pair).alias("links"), line.alias("line"))
    return F.when(word["a_ends"] == word["b_ends"], one_to_one).otherwise(let(F.array_intersect(word["a_ends"], word["b_ends"]), of))


def _documents(docs: Column, words: Column) -> Column:
    """Each document's columns from its words'."""
    by_word = F.struct(words["n_groups"].alias("n_groups"), words["line"].alias("line"))

    def made(w: Column) -> Column:
        total = lambda refs: F.aggregate(refs, F.lit(0).cast("long"), lambda acc, r: acc + F.get(w["n_groups"], r))
        return F.transform(docs, lambda d: F.struct(
            d["doc_id"].alias("doc_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), total(d["refs"]).alias("n_groups"),
            F.when(F.size(d["refs"]) > 0, F.sha2(F.array_join(F.transform(d["refs"], lambda r: F.get(w["line"], r)), ";").cast("binary"), 256)).otherwise("").alias("groups_sha256"),
        ))

    return let(by_word, made)


@contextmanager
def _sent(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs begun meanwhile send workers so many rows at once, or fewer if the session says so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment of all texts, written to the shared folder: batch, made (docs: an entry a document; links: of each distinct word), refs (each document's words)."""
    rows = tokenised(docs, byte_level, pieces, id_col, text_col)
    made = let(F.transform("words", aligned), lambda own: F.struct(_documents(F.col("docs"), own).alias("docs"), own["links"].alias("links")))
    with _sent(docs.sparkSession, SENT_ROWS):
        return written(rows.select("batch", made.alias("made"), F.transform("docs", lambda d: d["refs"]).alias("refs")), "aligned", **ROW_BY_ROW)


def linked_pairs(alignment: DataFrame, distinct: bool) -> DataFrame:
    """batch, place, pair: each document's links (its place in the batch's docs), once each if distinct."""
    of = lambda refs: F.flatten(F.transform(refs, lambda r: F.get(F.col("made.links"), r)))
    lists = F.transform("refs", lambda refs: F.array_distinct(of(refs)) if distinct else of(refs))
    return alignment.select("batch", F.posexplode(lists).alias("place", "links")).select("batch", "place", F.explode("links").alias("pair"))


def pair_counts(alignment: DataFrame) -> DataFrame:
    """pair, docs (how many documents hold it linked), best (whether no pair of its A id has more)."""
    counts = written(linked_pairs(alignment, True).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")).withColumn("a", F.shiftright("pair", 32)), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return written(counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "counts")


def align_documents(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Tokens of A are those of space and text; B adds that space itself. n_best: links whose pair's number
    of documents is the highest of its A id, ties included; count_sum: these numbers summed over links.
    Texts that are null or empty, or that either vocabulary changes (so that its tokens' bytes aren't the
    text's), have no tokens: zeros and ''. Repeated rows count as documents of their own; empty tables
    give none. Columns of docs besides id and text are not read.
    """
    alignment = align(docs, byte_level, pieces, id_col, text_col)
    counts = pair_counts(alignment)
    rows = linked_pairs(alignment, False)
    small = if_small(counts, broadcast_pairs)
    # more pairs than can be broadcast: those with a large share of all links still are, the others shuffle
    joined = rows.join(small, "pair") if small is not counts else join_groups(rows, counts, "pair", "docs", counts.agg(F.sum("docs")).first()[0])
    sums = joined.groupBy("batch", "place").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("docs").alias("count_sum"), F.count(F.lit(1)).alias("n_links"))
    own = alignment.select("batch", F.posexplode("made.docs").alias("place", "d")).select("batch", "place", "d.*")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return own.join(sums, ["batch", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
