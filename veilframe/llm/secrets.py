"""Secret scans: fixed patterns, and character Markov models for random strings without a telling name.

Built-in functions only. Places of matches come from splitting a text at them: the lengths of the
parts and of the matches add up to positions. A string of the right form counts as random if its
transitions are likelier under the model of random strings than under that of ordinary words.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.transforms import let, running

#: Kinds in the order that breaks ties, with pattern, group that is measured and its least length (fixed values).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LEAST_LENGTH = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}" % LEAST_LENGTH
#: Bits per transition that a candidate must be likelier as random string.
LEAST_BITS = 1.0
#: Documents (expected number) that ordinary words are learned from, and number of random strings.
LEARN_DOCS, RANDOM_STRINGS = 2000, 4000

_SPANS = "array<struct<start:int,end:int,rank:int,kind:string>>"


def _prefilter(pattern: str, least: int) -> str:
    """Runs of one character class can only be long enough where so many stand together, which regex engines reject sooner."""
    return {r"AKIA[A-Z0-9]+": r"AKIA[A-Z0-9]{%d}" % (least - 4), r"[0-9a-f]+": r"[0-9a-f]{%d}" % least}.get(pattern, pattern)


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<start, end, string> of leftmost non-overlapping matches, [start, end) in code points, of which the group has at least `least` characters."""
    found = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("measured"))

    def of(m: Column) -> Column:
        whole = m["whole"]
        ends = running(F.zip_with(F.slice(m["parts"], F.lit(1), F.size(whole)), whole, lambda part, own: F.char_length(part) + F.char_length(own)), F.lit(0), lambda a, b: a + b)
        return let(ends, lambda at: F.arrays_zip(at.alias("end"), whole.alias("string"), m["measured"].alias("measured")))

    kept = F.filter(let(found, of), lambda x: F.char_length(x["measured"]) >= least)
    return F.transform(kept, lambda x: F.struct((x["end"] - F.char_length(x["string"])).alias("start"), x["end"].alias("end"), x["string"].alias("string")))


def find_spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """The places of those matches, with their kind."""
    spans = F.transform(_matches(text, pattern, group, least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))
    return F.when(text.rlike(_prefilter(pattern, least)), spans).otherwise(F.array().cast(_SPANS))


def apart(candidates: Column, base: Column) -> Column:
    """The candidates (start, end, string) that overlap no base span: one sort of both and a running maximum of the ends of base spans."""
    ends = F.transform(candidates, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("base"), x["start"].alias("start"), x["string"].alias("string")))
    starts = F.transform(base, lambda x: F.struct(x["start"].alias("at"), x["end"].alias("base"), F.lit(0).alias("start"), F.lit("").alias("string")))

    def of(events: Column) -> Column:  # in order of a candidate's end and a base span's start: at a candidate, all base spans that start before its end are known
        reached = running(F.transform(events, lambda e: e["base"]), F.lit(0), lambda a, b: F.greatest(a, b))
        return let(reached, lambda most: F.filter(F.arrays_zip(events.alias("own"), most.alias("most")), lambda x: (x["own"]["base"] == 0) & (x["most"] <= x["own"]["start"])))

    kept = let(F.array_sort(F.concat(ends, starts)), of)
    return F.transform(kept, lambda x: F.struct(x["own"]["start"].alias("start"), x["own"]["at"].alias("end"), x["own"]["string"].alias("string")))


def transition_bits(samples: DataFrame, text_col: str = "text", random_col: str = "random") -> list[float]:
    """log2 of each transition's probability in random strings over that in ordinary ones, by first and second character of ALPHABET.

    samples: strings and whether they are random (true) or ordinary (false); nulls in either column teach
    nothing. Counts start at 1/2. Two rows for each pair of characters at most reach the driver.
    """
    size = len(ALPHABET)
    usable = samples.filter(F.col(random_col).isNotNull() & (F.char_length(text_col) >= 2)).select(F.col(random_col).alias("random"), F.col(text_col).alias("text"))
    pairs = usable.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("text") - 1), lambda i: F.substr("text", i, F.lit(2)))).alias("pair"))
    known = pairs.filter(F.col("pair").rlike(r"\A[A-Za-z0-9+/_-]{2}\z"))
    counts = {kind: [[0.5] * size for _ in ALPHABET] for kind in (True, False)}
    for row in known.groupBy("random", "pair").count().collect():
        counts[row["random"]][ALPHABET.index(row["pair"][0])][ALPHABET.index(row["pair"][1])] += row["count"]
    share = {kind: [[n / sum(own) for n in own] for own in table] for kind, table in counts.items()}
    return [math.log2(a / b) for own, other in zip(share[True], share[False], strict=True) for a, b in zip(own, other, strict=True)]


def likelihood_ratio(string: Column, bits: list[float]) -> Column:
    """Bits by which the string's transitions are likelier as random than as ordinary ones; other characters count for nothing."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in bits)), ",").cast("array<double>")  # folded to an array before the query runs
    size = len(ALPHABET)

    def of(codes: Column) -> Column:
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.when((a >= 0) & (b >= 0), a * size + b))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, pair: acc + F.coalesce(F.get(table, pair), F.lit(0.0)))

    codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.when(F.char_length(string) < 2, 0.0).otherwise(let(codes, of))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_docs: int = LEARN_DOCS, random_strings: int = RANDOM_STRINGS) -> list[float]:
    """Transition bits from labelled samples: base64 digests as random strings; as ordinary ones the words of about learn_docs documents in which no base pattern matches."""
    spark = docs.sparkSession
    count = docs.count()
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit("ordinary")), F.lit(1_000_003)) / 1_000_003.0
    plain = reduce(lambda a, b: a & b, [~F.col(text_col).rlike(_prefilter(p, least)) for _, p, _, least in BASE])
    words = docs.filter(at < min(1.0, learn_docs / max(count, 1))).filter(plain).select(F.explode(F.split(text_col, r"[^A-Za-z0-9+/_-]+")).alias("text")).filter(F.char_length("text").between(4, 64))
    random = spark.range(random_strings).select(F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "=", "").alias("text"))
    return transition_bits(words.withColumn("random", F.lit(False)).unionByName(random.withColumn("random", F.lit(True))))


def scan(docs: DataFrame, bits: list[float], id_col: str = "doc_id", text_col: str = "text", least_bits: float = LEAST_BITS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row.

    Spans are kind:start:end, code points, end exclusive, by start, then kind as in BASE, comma-joined;
    base_sha256 digests those of BASE, spans has all: also `random`, strings of CANDIDATE that overlap no
    base span and whose likelihood ratio is at least least_bits a transition. Null texts are empty: no
    spans. Repeated rows give repeated results; empty tables none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"))
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        rows = rows.withColumn(f"_{kind}", find_spans(F.col("_text"), kind, rank, pattern, group, least))
    rows = rows.withColumn("_base", F.array_sort(F.concat(*[f"_{kind}" for kind, *_ in BASE])))

    def random(own: Column) -> Column:
        likely = F.filter(apart(own, F.col("_base")), lambda x: likelihood_ratio(x["string"], bits) >= least_bits * (F.char_length(x["string"]) - 1))
        return F.transform(likely, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(len(BASE)).alias("rank"), F.lit("random").alias("kind")))

    candidates = _matches(F.col("_text"), CANDIDATE, 0, LEAST_LENGTH)
    rows = rows.withColumn("_random", F.when(F.col("_text").rlike(CANDIDATE), let(candidates, random)).otherwise(F.array().cast(_SPANS)))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return rows.select(
        "doc_id",
        *[F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind, *_ in BASE],
        F.size("_random").cast("long").alias("n_random"),
        F.sha2(line(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        line(F.array_sort(F.concat("_base", "_random"))).alias("spans"),
    )
