"""Masks: whole values, templates of kept ends, templates by segment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.regex import quoted
from veilframe.plans.rules import Rule, Segment, SegmentTemplate, SimpleTemplate


def _stars(char: str, count: Column) -> Column:
    return F.repeat(F.lit(char), count.cast("int"))


def mask_generic(text: Column) -> Column:
    """Keeps the first and the last character of three or more; one or two are hidden."""
    n = F.char_length(text)
    return F.when(n <= 2, _stars("*", n)).otherwise(F.concat(F.substr(text, F.lit(1), F.lit(1)), _stars("*", n - 2), F.substr(text, n, F.lit(1))))


def mask_name(text: Column, char: str) -> Column:
    """One character is hidden, of two the second, of more all but the first and the last."""
    n = F.char_length(text)
    first = F.substr(text, F.lit(1), F.lit(1))
    return (
        F.when(n == 0, "").when(n == 1, char).when(n == 2, F.concat(first, F.lit(char)))
        .otherwise(F.concat(first, _stars(char, n - 2), F.substr(text, n, F.lit(1))))
    )


def mask_ends(text: Column, keep_prefix: int, keep_suffix: int, char: str, least: int) -> Column:
    """Keeps both ends and hides the middle, by `least` characters at least; if the ends meet only those are left."""
    n = F.char_length(text)
    middle = n - keep_prefix - keep_suffix
    kept = F.concat(F.substr(text, F.lit(1), F.lit(keep_prefix)), _stars(char, F.greatest(middle, F.lit(least))), F.substr(text, n - keep_suffix + 1))
    return F.when(n - keep_suffix <= keep_prefix, F.lit(char * least)).otherwise(kept)


def mask_middle(text: Column, keep_prefix: int, keep_suffix: int, char: str, least: int) -> Column:
    """The reverse: hides both ends and keeps the middle; if the ends meet all is hidden."""
    n = F.char_length(text)
    kept = F.concat(F.lit(char * keep_prefix), F.substr(text, F.lit(keep_prefix + 1), n - keep_prefix - keep_suffix), F.lit(char * keep_suffix))
    return F.when(n == 0, "").when(n - keep_suffix <= keep_prefix, _stars(char, F.greatest(n, F.lit(least)))).otherwise(kept)


def mask_segments(text: Column, template: SegmentTemplate, char: str) -> Column:
    """Masks the listed parts between delimiters, counted from 0; others stay. The first entry for a part holds."""
    entries: dict[int, Segment] = {}
    for s in template.segments:
        entries.setdefault(s.index, s)

    def part(x: Column, i: Column) -> Column:
        return reduce(
            lambda rest, s: F.when(i == s.index, mask_ends(x, s.keep_prefix or 0, s.keep_suffix or 0, char, 1 if s.mask_min_len is None else s.mask_min_len)).otherwise(rest), entries.values(), x
        )

    return F.array_join(F.transform(F.split(text, quoted(template.delimiter), -1), part), template.delimiter)


def mask(text: Column, rule: Rule | None = None) -> Column:
    """The value masked as the rule says; null counts as empty. Without a mask rule: mask_generic.

    The mask character is the rule's replacement, else the template's, else *.
    """
    value = F.coalesce(text, F.lit(""))
    if rule is None or rule.kind != "mask":
        return mask_generic(value)
    template = rule.template
    char = (rule.replacement or "")[:1] or (template.mask_char or "")[:1] if template else (rule.replacement or "")[:1]
    char = char or "*"
    if template is None:
        return mask_name(value, char)
    if template.is_empty():
        return value
    if isinstance(template, SegmentTemplate):
        return mask_segments(value, template, char)
    return _simple(value, template, char)


def _simple(value: Column, template: SimpleTemplate, char: str) -> Column:
    made = mask_middle if template.reverse else mask_ends
    return made(value, template.keep_prefix or 0, template.keep_suffix or 0, char, 1 if template.mask_min_len is None else template.mask_min_len)


def validate_then_mask(text: Column, valid: Column, rule: Rule | None = None, invalid_text: str = "INVALID") -> Column:
    return F.when(valid, mask(text, rule)).otherwise(F.lit(invalid_text))
