"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are distinct shingle sets, columns are n-grams cut into blocks by hash. Set sizes
bound how much two similar sets can differ, and so give a number of column blocks of which one must
agree whole: only rows that agree on a block meet. They meet in tiles of rows by rows, first by their
sizes and counts of n-grams per column range, which bound how many n-grams two sets have apart from
below; only the rows that have a pair left send their n-grams. The product then adds up overlap
counts over slices of columns and discards pairs that their sizes no longer allow. Rows that many
others agree with are cut over as many tiles as they need; no pairs leave a tile, only each row's
number of links and one link to its group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import if_small, join_groups, slices, texts, written
from veilframe.llm.components import connected_components
from veilframe.llm.hashing import mix, shingle_set

WIDTH = 3
#: Linked if DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 90, 100
#: Rows of a tile's side at most, columns of a slice, n-grams of a tile (8 bytes each): rows of long sets come in smaller tiles.
TILE, SLICE, TILE_GRAMS = 1024, 4096, 1 << 23
#: Candidates and the tiles they meet in are broadcast to their texts up to so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Rows that a task sifts: few bytes but many pairs, so that adaptive execution would give it too many.
SIFT_ROWS = 10_000
#: Sets that a task remembers to have put out already.
REMEMBERED = 100_000

_NO_ID = 2**63 - 1


class Levels:
    """Intervals of set sizes such that similar sets lie in the same or in neighbouring ones."""

    def __init__(self, numerator: int, denominator: int):
        self.numerator, self.denominator = numerator, denominator
        self.least, self.most = [1], [denominator // numerator]
        self.cut: dict[int, tuple[int, int]] = {}

    def of(self, size: int) -> int:
        while self.most[-1] < size:
            self.least.append(self.most[-1] + 1)
            self.most.append(self.least[-1] * self.denominator // self.numerator)
        return int(np.searchsorted(self.least, size, "right")) - 1

    def blocks(self, level: int) -> tuple[int, int]:
        """The number of column blocks, and how many of them two similar sets of up to this level's sizes can differ in: no more than the n-grams they have apart.

        A set whose n-grams fill more blocks than that agrees on a filled one with each similar set. So
        there are enough blocks that the smallest sets of a level nearly always fill as many, yet few,
        as larger blocks have fewer chance agreements.
        """
        if level not in self.cut:
            while len(self.most) <= level:
                self.of(self.most[-1] + 1)
            apart = 2 * self.most[level] * (self.denominator - self.numerator) // (self.denominator + self.numerator)
            size, n = self.least[max(level - 1, 0)], apart + 1

            def filled(n: int) -> float:
                empty = n * math.exp(-size / n)
                return n - empty - 4 * math.sqrt(empty)

            while n < 2 * apart + 2 and filled(n) < apart + 1:
                n += 1
            self.cut[level] = n, apart
        return self.cut[level]


def block_hashes(grams: np.ndarray, levels: Levels) -> np.ndarray:
    """A hash of the set's n-grams in each filled column block, at the level of its size and at the next one; its last five bits are the bits of the level's largest size.

    A set that fills too few blocks has hashes of its empty ones too, as it may agree with a like set on those only.
    """
    own = levels.of(len(grams))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams))])
    found = []
    for level in (own, own + 1):
        n, apart = levels.blocks(level)
        cuts = np.searchsorted(grams, np.arange(1, n, dtype=np.uint64) * np.uint64((2**64 - 1) // n))
        ends = np.concatenate([[0], cuts, [len(grams)]])
        hashed = mix(sums[ends[1:]] - sums[ends[:-1]] + mix(np.arange(n, dtype=np.uint64) + np.uint64(level << 40)))
        filled = ends[1:] > ends[:-1]
        if filled.sum() > apart:
            hashed = hashed[filled]
        found.append(hashed >> np.uint64(5) << np.uint64(5) | np.uint64(min(levels.most[level].bit_length(), 31)))
    return np.concatenate(found).view(np.int64)


def column_counts(grams: np.ndarray) -> bytes:
    """The set's n-grams in each of 2**k equal ranges of columns, a byte each (255 at most): four to eight in a range on average."""
    bits = max(len(grams).bit_length() - 3, 0)
    own = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    return np.minimum(np.bincount(own, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def counts_matrix(counts: list[bytes]) -> np.ndarray:
    """A row for each set, with as many ranges as the set of fewest has: neighbouring ranges of the others are added up."""
    least = min(len(c) for c in counts)
    return np.stack([np.frombuffer(c, np.uint8).reshape(least, -1).sum(1, dtype=np.int32) for c in counts])


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _rows(width: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = Levels(numerator, denominator), set()
        for part in slices(batches):
            sizes, keys, blocks, counts = [], [], [], []
            for text in texts(part.column("text")):
                grams = shingle_set(text, width)
                key = set_key(grams) if len(grams) else None
                sizes.append(len(grams))
                keys.append(key)
                known = key is None or key in seen
                blocks.append(None if known else block_hashes(grams, levels))
                counts.append(None if known else column_counts(grams))
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(blocks, pa.list_(pa.int64())), pa.array(counts, pa.binary())], ["_id", "n", "key", "blocks", "counts"])

    return run


def _short(key: str = "key"):
    return F.conv(F.substring(F.hex(key), 1, 15), 16, 10).cast("long")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (block, sid) in order: each sid with the least one that agrees with it on a block, and the bits of their largest size."""
    at, pivot, last = None, None, None
    for batch in batches:
        block, sid = batch.column("block").to_numpy(), batch.column("sid").to_numpy()
        if not len(block):
            continue
        opens = np.empty(len(block), bool)
        opens[0] = at is None or block[0] != at
        np.not_equal(block[1:], block[:-1], out=opens[1:])
        first = np.maximum.accumulate(np.where(opens, np.arange(len(block)), -1))
        own = np.where(first >= 0, sid[first], sid[0] if pivot is None else pivot)
        before = np.concatenate([[sid[0] + 1 if last is None else last], sid[:-1]])
        keep = (sid != own) & ((sid != before) | opens)
        at, pivot, last = block[-1], own[-1], sid[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(sid[keep]), pa.array((block[keep] & 31).astype(np.int32))], ["pivot", "sid", "bits"])


def _contents(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows can share an id, and so be wanted many times over
        for part in slices(batches):
            keys, contents = [], []
            for text in texts(part.column("text")):
                grams = shingle_set(text, width)
                key = set_key(grams)
                if key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    contents.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(contents, pa.binary())], ["key", "grams"])

    return run


def overlaps(sets: list[np.ndarray], live: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Which of the live pairs are linked: the product of the incidence matrix with its transpose, by slices of columns."""
    sizes = np.array([len(s) for s in sets], np.int64)
    total = sizes[:, None] + sizes[None, :]
    need = -(-numerator * total // (numerator + denominator))  # least intersection
    live = live & (np.minimum(sizes[:, None], sizes[None, :]) >= need)
    if not live.any():
        return live
    row = np.repeat(np.arange(len(sets)), sizes)
    grams, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    shared = often[column] > 1
    row, column = row[shared], number[column[shared]]
    width = int((often > 1).sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts, left = np.zeros_like(total), np.bincount(row, minlength=len(sets))
    for start in range(0, width, SLICE):
        a, b = np.searchsorted(column, [start, start + SLICE])
        tile = np.zeros((len(sets), min(SLICE, width - start)), np.float32)
        tile[row[a:b], column[a:b] - start] = 1
        counts += (tile @ tile.T).astype(np.int64)
        left = left - np.bincount(row[a:b], minlength=len(sets))
        live &= counts + np.minimum(left[:, None], left[None, :]) >= need
        if not live.any():
            break
    return live & (denominator * counts >= numerator * (total - counts))


def _pairs(rows: pa.Table) -> np.ndarray:
    """Which pairs of a tile's rows are counted in it: those of its two parts that don't meet under a lesser pivot too."""
    pivot, left, right = (rows.column(c)[0].as_py() for c in ("pivot", "left", "right"))
    n, part = rows.num_rows, rows.column("part").to_numpy()
    live = np.triu(np.ones((n, n), bool), 1) if left == right else (part[:, None] == left) & (part[None, :] == right)
    earlier = [[p for p in own if p < pivot] for own in rows.column("pivots").to_pylist()]
    known = {p: k for k, p in enumerate({p for own in earlier for p in own})}
    if known:
        meets = np.zeros((n, len(known)), np.float32)
        for k, own in enumerate(earlier):
            meets[k, [known[p] for p in own]] = 1
        live &= meets @ meets.T == 0
    return live


#: Columns of the rows that sifting leaves.
SIFTED = [("key", pa.binary()), ("first_id", pa.int64()), ("copies", pa.int64()), ("pivots", pa.list_(pa.int64())), ("pivot", pa.int64()), ("part", pa.int32()), ("left", pa.int32()), ("right", pa.int32())]


def possible(sizes: np.ndarray, counts: list[bytes], live: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Which of the live pairs may be linked: each n-gram that two counts of a range differ by is in one set only."""
    total = sizes[:, None] + sizes[None, :]
    apart = total - 2 * -(-numerator * total // (numerator + denominator))  # n-grams that linked sets have apart at most
    live = live & (np.abs(sizes[:, None] - sizes[None, :]) <= apart)
    matrix = counts_matrix(counts)
    for k in np.flatnonzero(live.any(1)):
        other = np.flatnonzero(live[k])
        live[k, other] = np.abs(matrix[other] - matrix[k]).sum(1) <= apart[k, other]
    return live


def _sift(numerator: int, denominator: int):
    def run(rows: pa.Table) -> pa.Table:
        live = possible(rows.column("n").to_numpy(), rows.column("counts").to_pylist(), _pairs(rows), numerator, denominator)
        kept = rows.select([name for name, _ in SIFTED]).filter(pa.array(live.any(0) | live.any(1)))
        return kept.cast(pa.schema(SIFTED))

    return run


def _tile(numerator: int, denominator: int):
    def run(rows: pa.Table) -> pa.Table:
        first: dict[bytes, int] = {}
        for k, key in enumerate(rows.column("key").to_pylist()):
            first.setdefault(key, k)
        if len(first) < rows.num_rows:
            rows = rows.take(list(first.values()))
        linked = overlaps([np.frombuffer(g, np.uint64) for g in rows.column("grams").to_pylist()], _pairs(rows), numerator, denominator)
        linked |= linked.T
        some = np.flatnonzero(linked.any(1))
        linked = linked[np.ix_(some, some)]
        root = np.arange(len(some))
        while True:
            lower = np.minimum(root, np.where(linked, root[None, :], len(some)).min(1, initial=len(some)))
            if (lower == root).all():
                break
            root = lower
        keys, copies = rows.column("key").combine_chunks().take(pa.array(some)), rows.column("copies").to_numpy()[some]
        return pa.table({"key": keys, "links": pa.array(linked @ copies, pa.int64()), "root": keys.take(pa.array(root))})

    return run


def _if_narrow(sifted: DataFrame) -> DataFrame:
    """The candidates marked for broadcast if their rows (100 bytes, and 8 for each pivot) stay under BROADCAST_BYTES."""
    size = sifted.agg(F.sum(100 + 8 * F.size("pivots"))).first()[0] or 0
    return F.broadcast(sifted) if size <= BROADCAST_BYTES else sifted


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, numerator: int, denominator: int, roots: bool = False) -> DataFrame:
    """_id (_NO_ID for null), n, key, component_id (null without links), n_links of every row; with `roots` also root, a set's key that only the row's component has."""
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.col(text_col).alias("text"))
    rows = written(source.mapInArrow(_rows(width, numerator, denominator), "_id long, n long, key binary, blocks array<long>, counts binary"), "shingles")
    sets = rows.filter("n > 0").groupBy("key").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("counts").alias("counts"))

    dealt = rows.select(F.explode("blocks").alias("block"), _short().alias("sid")).repartition("block").sortWithinPartitions("block", "sid")
    met = dealt.mapInArrow(_agreeing, "pivot long, sid long, bits int").groupBy("pivot", "sid").agg(F.max("bits").alias("bits"))
    met = written(met, "agreeing")
    pairs = met.select("pivot", "sid")
    groups = pairs.unionByName(pairs.select("pivot", F.col("pivot").alias("sid")).distinct())
    side = F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(F.lit(TILE_GRAMS) / F.pow(F.lit(2), F.max("bits") + 1))))
    sizes = written(met.groupBy("pivot").agg(F.ceil((F.count(F.lit(1)) + 1) / side).cast("int").alias("parts")), "pivots")
    members = groups.join(if_small(sizes), "pivot").groupBy("sid").agg(F.collect_list(F.struct("pivot", "parts")).alias("of"))  # pivots of one set: fewer than its blocks

    chosen = written(sets.withColumn("sid", _short()).join(members, "sid").select("key", "first_id", "copies", "n", "counts", "of"), "candidates")
    parts = F.col("at.parts")
    own = F.pmod(F.xxhash64("key"), parts).cast("int")
    met_in = (
        chosen.select("key", "first_id", "copies", "n", "counts", F.col("of.pivot").alias("pivots"), F.explode("of").alias("at"))
        .select("*", F.col("at.pivot").alias("pivot"), own.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("key", "first_id", "copies", "n", "counts", "pivots", "pivot", "part", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"))
    )
    places = chosen.agg(F.sum(F.aggregate("of", F.lit(0).cast("long"), lambda n, at: n + at["parts"]))).first()[0] or 0
    tasks = max(places // SIFT_ROWS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sifted = met_in.repartition(tasks, "pivot", "left", "right").groupBy("pivot", "left", "right").applyInArrow(_sift(numerator, denominator), "key binary, first_id long, copies long, pivots array<long>, pivot long, part int, left int, right int")
    sifted = written(sifted, "sifted")

    wanted = if_small(written(sifted.select(F.col("first_id").alias("_id")).distinct(), "wanted"))
    contents = source.join(wanted, "_id", "left_semi").select("text").mapInArrow(_contents(width), "key binary, grams binary")
    tiles = contents.join(_if_narrow(sifted.drop("first_id")), "key")
    found = written(tiles.groupBy("pivot", "left", "right").applyInArrow(_tile(numerator, denominator), "key binary, links long, root binary"), "links")

    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    reached = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = reached.withColumnRenamed("node", "key").join(chosen.select("key", "first_id"), "key")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    root = ["root"] if roots else []
    grouped = named.join(least, "component").select("key", "component_id", *[F.col("component").alias(c) for c in root])
    several = (
        sets.filter("copies > 1").select("key", "copies", F.col("first_id").alias("component_id"), F.lit(0).cast("long").alias("links"), *[F.lit(None).cast("binary").alias(c) for c in root])
        .unionByName(grouped.join(linked, "key").select("key", F.lit(0).cast("long").alias("copies"), "component_id", "links", *root))
        .groupBy("key").agg(F.max("copies").alias("copies"), F.min("component_id").alias("component_id"), F.max("links").alias("links"), *[F.max(c).alias(c) for c in root])
    )
    of_group = [F.coalesce(c, "key").alias(c) for c in root]
    several = written(several.select("key", "component_id", F.col("copies"), (F.greatest(F.col("copies") - 1, F.lit(0)) + F.col("links")).alias("n_links"), *of_group), "groups")
    return join_groups(rows.select("_id", "n", "key"), several, "key", "copies", rows.count())


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row.

    Words are runs of anything but ASCII white space, A-Z as a-z; a row's set are its distinct shingles
    of `width` words, with fewer words the whole sequence. Two rows are linked if the Jaccard
    similarity of their sets is at least numerator / denominator; rows with equal sets are.
    component_id: the least id that links reach; n_links: other rows that a row is linked with.
    Null texts and texts without words have no shingles, no links and their own id as component.
    Rows without an id take part, and a component of only such rows has none. Repeated rows are rows of
    their own. An empty table gives no rows. No link is lost, and no group is cut short.
    """
    joined = _joined(docs, id_col, text_col, width, numerator, denominator)
    doc_id = lambda c: F.when(F.col(c) == _NO_ID, F.lit(None)).otherwise(F.col(c)).cast("long")
    return joined.withColumn("component_id", F.coalesce("component_id", "_id")).select(
        doc_id("_id").alias("doc_id"), F.col("n").alias("n_shingles"), doc_id("component_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def _keys(width: int):
    @F.arrow_udf("binary")
    def keys(column: pa.Array) -> pa.Array:
        """Each text's set key, as _rows gives it; empty without shingles."""
        grams = (shingle_set(t, width) for t in texts(column))
        return pa.array([set_key(g) if len(g) else b"" for g in grams], pa.binary())

    return keys


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """docs with one row of each component of ngram_join, that of the least id, all columns as they are.

    Rows without links all stay, also those that share an id with others and those without words. Where
    rows of a component share its least id, the one whose set has the greatest key stays, and one of rows
    with equal sets. Rows without an id come after all others.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    repeated = written(docs.groupBy(own_id.alias("_id")).count().filter(f"count > 1 or _id = {_NO_ID}").select("_id"), "repeated")
    some = not repeated.isEmpty()
    joined = _joined(docs.select(id_col, text_col), id_col, text_col, width, numerator, denominator, roots=some)
    linked = written(joined.filter(f"_id <> {_NO_ID} and component_id <> _id").select(F.col("_id").alias(id_col)).distinct(), "linked")
    if not some:
        return docs.join(if_small(linked), id_col, "left_anti").select(*columns)

    # An id stands for several rows here: which of them stays is told by their sets.
    again = if_small(repeated)
    marked = docs.select(own_id.alias("_id"), F.col(text_col).alias("_text"), F.struct(*columns).alias("row"))
    once = marked.join(again, "_id", "left_anti").select("row.*").join(if_small(linked), id_col, "left_anti").select(*columns)
    rows = joined.join(again, "_id", "left_semi").filter("key is not null and (component_id is null or component_id = _id)")
    stay = rows.groupBy("_id", F.coalesce("root", "key").alias("root")).agg(F.max("key").alias("key")).select("_id", "key")
    several = marked.join(again, "_id", "left_semi").select("_id", "row", _keys(width)("_text").alias("key"))
    bare = several.filter(F.octet_length("key") == 0).select("row.*")
    kept = several.filter(F.octet_length("key") > 0).join(written(stay, "stay"), ["_id", "key"], "left_semi").dropDuplicates(["_id", "key"])
    return once.unionByName(kept.select("row.*")).unionByName(bare)
