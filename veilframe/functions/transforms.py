"""Transforms of one column's values: Base64, digests, case, replacement. Null stays null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.errors import InvalidInput
from veilframe.functions import regex

_BASE64 = r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def base64_encode(text: Column) -> Column:
    """Standard alphabet, padded, on one line."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\r\n]", "")


def base64_decode(text: Column) -> Column:
    """Strict: null for what isn't canonical padded Base64 of UTF-8 text."""
    raw = F.when(text.rlike(_BASE64), F.try_to_binary(text, F.lit("base64")))
    canonical = F.regexp_replace(F.base64(raw), "[\r\n]", "") == text
    return F.when(canonical, F.try_validate_utf8(raw.cast("string")))


def digest(text: Column, algorithm: str, upper: bool = False) -> Column:
    """md5, sha1 or sha256 in hex of the UTF-8 text; the empty text is digested too."""
    data = text.cast("binary")
    made = {"md5": lambda: F.md5(data), "sha1": lambda: F.sha1(data), "sha256": lambda: F.sha2(data, 256)}
    if algorithm not in made:
        raise InvalidInput(f"unknown digest {algorithm!r}")
    return F.upper(made[algorithm]()) if upper else made[algorithm]()


def change_case(text: Column, to: str) -> Column:
    if to not in ("upper", "lower"):
        raise InvalidInput(f"unknown case {to!r}")
    return F.upper(text) if to == "upper" else F.lower(text)


def replace(text: Column, old: str, new: str, use_regex: bool = False) -> Column:
    if not old:
        raise InvalidInput("nothing to replace")
    return regex.replace_all(text, old, new) if use_regex else F.replace(text, F.lit(old), F.lit(new))


def contains_keyword(text: Column, keyword: str) -> Column:
    """Whether the text holds the keyword; ASCII letters (and no others) in either case."""
    return text.rlike("(?i)" + regex.quoted(keyword)) if keyword else text.isNotNull()


_SPANS = "array<struct<start:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What step makes of all elements up to each element, from start on; step must be associative.

    Appending to an array copies it, so n results are made in about sqrt(n) stretches of as many elements:
    each stretch's total first, then the results in each from the total before it.
    """
    gather = lambda array, first: F.aggregate(array, F.struct(first.alias("at"), F.slice(F.array(first), 1, 0).alias("all")), _append(step), lambda acc: acc["all"])

    def stretches(own: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(own))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(own), F.lit(1)) - 1) / size).cast("int")), lambda k: F.slice(own, k * size + 1, size))

    def results(parts: Column) -> Column:
        totals = gather(F.transform(parts, lambda part: F.aggregate(part, start, step)), start)
        before = F.concat(F.array(start), F.slice(totals, F.lit(1), F.size(totals) - 1))
        return F.flatten(F.zip_with(parts, before, gather))

    return let(values, lambda own: let(stretches(own), results))


def _append(step: Callable[[Column, Column], Column]):
    def add(acc: Column, x: Column) -> Column:
        return let(step(acc["at"], x), lambda made: F.struct(made.alias("at"), F.concat(acc["all"], F.array(made)).alias("all")))

    return add


def _places(gaps: Column, sizes: Column) -> Column:
    """Spans of matches from the length of the text before each and their own lengths."""

    def spans(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, b: a + b)
        return F.zip_with(both, ends, lambda x, end: F.struct((end - x["size"]).cast("int").alias("start"), end.cast("int").alias("end")))

    return let(F.arrays_zip(gaps.alias("gap"), sizes.alias("size")), spans)


def keyword_spans(text: Column, keyword: str) -> Column:
    """[start, end) in UTF-8 bytes of the keyword's occurrences, case-sensitive, leftmost and non-overlapping."""
    none = F.array().cast(_SPANS)
    if not keyword:
        return none
    size = len(keyword.encode())

    def spans(gaps: Column) -> Column:
        return _places(gaps, F.transform(gaps, lambda _: F.lit(size)))

    gaps = let(F.split(text, regex.quoted(keyword), -1), lambda parts: F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.octet_length))
    return F.when(text.contains(keyword), let(gaps, spans)).otherwise(none)


def with_matches(text: Column, java: str, body: Callable[[Column, Column], Column], length: Callable[[Column], Column]) -> Column:
    """body(matches, their [start, end) as length counts), each worked out once; an empty match at the very start is passed over."""

    def of(found: Column) -> Column:
        # splitting passes over it too, so that there are as many parts as matches
        every, parts = found["every"], found["parts"]
        hits = F.when(F.size(parts) > F.size(every), every).otherwise(F.slice(every, F.lit(2), F.size(every)))
        return let(hits, lambda own: let(_places(F.transform(F.slice(parts, F.lit(1), F.size(own)), length), F.transform(own, length)), lambda spans: body(own, spans)))

    return let(F.struct(F.regexp_extract_all(text, F.lit(java), F.lit(0)).alias("every"), F.split(text, java, -1).alias("parts")), of)


def pattern_spans(text: Column, pattern: str) -> Column:
    """[start, end) in UTF-8 bytes of a pattern's matches; empty matches are left out."""
    java = regex.checked(pattern)
    spans = with_matches(text, java, lambda _, spans: F.filter(spans, lambda x: x["end"] > x["start"]), F.octet_length)
    return F.when(text.rlike(java), spans).otherwise(F.array().cast(_SPANS))
