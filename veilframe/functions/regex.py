"""Patterns and replacements of a linear-time regex dialect as java.util.regex takes them.

The dialect: \\d, \\w, \\s and \\b are Unicode-aware, $ is the end of the text (not also before a last
line break), neither look-around nor back-references, and replacements write $name, ${name}, $1, $$.
Java backtracks, so patterns that could take it exponential time are refused (see ambiguity.py).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilframe.errors import InvalidInput
from veilframe.functions.ambiguity import exponential

_group = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>")
_counted = re.compile(r"\{\d+(?:,\d*)?\}\+")
_property = re.compile(r"((?<!\\)(?:\\\\)*\\[pP])\{(\^?)(?!Is|In|java)([A-Z][A-Za-z_]{2,})\}")
#: Names that Java knows without a prefix (fixed values).
_POSIX = ("Lower", "Upper", "ASCII", "Alpha", "Digit", "Alnum", "Punct", "Graph", "Print", "Blank", "Cntrl", "XDigit", "Space")
_reference = re.compile(r"\$(?:\$|\{([^}]*)\}|([0-9A-Za-z_]+))")


def _tokens(pattern: str):
    """(token, inside a class) from left to right; an escape is one token."""
    k, inside = 0, 0
    while k < len(pattern):
        size = 2 if pattern[k] == "\\" and k + 1 < len(pattern) else 1
        token = pattern[k : k + size]
        if token == "[":
            inside += 1
        yield k, token, inside > 0
        if token == "]" and inside:
            inside -= 1
        k += size


def translate(pattern: str) -> str:
    """The pattern for Java; InvalidInput for what the dialect doesn't have."""
    multiline = re.match(r"\(\?[a-zA-Z]*m[a-zA-Z]*\)", pattern)
    out, named = [], 0
    for k, token, in_class in _tokens(pattern):
        if not in_class and re.match(r"\(\?(?:=|!|<=|<!)", pattern[k:]):
            raise InvalidInput(f"look-around is not supported: {pattern}")
        if not in_class and re.fullmatch(r"\\[1-9]", token):
            raise InvalidInput(f"back-references are not supported: {pattern}")
        if not in_class and pattern.startswith("(?>", k):
            raise InvalidInput(f"atomic groups are not supported: {pattern}")
        if not in_class and (token == "+" and out[-1:] in (["*"], ["+"], ["?"]) or token == "{" and _counted.match(pattern, k)):
            raise InvalidInput(f"repetitions that give nothing back are not supported: {pattern}")
        if token == "$" and not in_class and not multiline:
            token = r"\z"
        out.append(token)
    text = _property.sub(lambda m: m[0] if m[3] in _POSIX else f"{m[1]}{{{m[2]}Is{m[3]}}}", "".join(out))

    def rename(_: re.Match) -> str:
        nonlocal named
        named += 1
        return f"(?<n{named}>"

    return "(?U)" + _group.sub(rename, text)


def group_numbers(pattern: str) -> tuple[int, dict[str, int]]:
    """How many groups a pattern captures, and the number of each named one."""
    count, names = 0, {}
    for k, token, in_class in _tokens(pattern):
        if token != "(" or in_class:
            continue
        name = _group.match(pattern, k)
        if name or not pattern.startswith("(?", k):
            count += 1
            if name:
                names[name[1]] = count
    return count, names


def translate_replacement(replacement: str, pattern: str) -> str:
    """The replacement for Java: groups by number, unknown groups empty, everything else literal."""
    count, names = group_numbers(pattern)
    out, at, after_group = [], 0, False

    def literal(text: str) -> None:
        nonlocal after_group
        for c in text:
            out.append("\\" + c if c in "\\$" or (after_group and c.isdigit()) else c)
            after_group = False

    for found in _reference.finditer(replacement):
        literal(replacement[at : found.start()])
        at = found.end()
        name = found[1] if found[1] is not None else found[2]
        if name is None:
            literal("$")
            continue
        number = int(name) if name.isdecimal() else names.get(name)
        if number is not None and number <= count:
            out.append(f"${number}")
            after_group = True
    literal(replacement[at:])
    return "".join(out)


def checked(pattern: str) -> str:
    """The pattern for Java, compiled once on the driver so that a bad one fails before a job starts; so does one that could take exponential time."""
    translated = translate(pattern)
    if exponential(pattern):
        raise InvalidInput(f"a repetition in {pattern!r} can match one text in many ways, which takes exponential time: write it without one repetition inside the other")
    spark = SparkSession.active()
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(translated)
    except Exception as e:  # a Java exception by way of the gateway
        raise InvalidInput(f"bad pattern {pattern!r}: {str(e).splitlines()[0]}") from None
    return translated


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(checked(pattern))


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(checked(pattern)), F.lit(0))


def replace_all(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, checked(pattern), translate_replacement(replacement, pattern))


def quoted(text: str) -> str:
    """A Java pattern for the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
