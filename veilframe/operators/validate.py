"""Validation of rows by several rules, split into a valid and an invalid sheet."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.errors import InvalidInput
from veilframe.functions import regex, transforms, validators
from veilframe.operators.columns import check_column
from veilframe.operators.sheet import ROW, headers
from veilframe.plans.rules import Rule

REASONS = "_reasons"
_REASON = "array<struct<field:string,reason:string>>"


@dataclass(frozen=True)
class CrossField:
    """Columns that an id card is compared with."""

    sex: str | None = None
    birth: str | None = None


@dataclass(frozen=True)
class ColumnRule:
    column: str
    rule: Rule
    cross_field: CrossField | None = None
    params: dict[str, Any] | None = None


def validity(value: Column, rule: Rule, params: dict[str, Any] | None = None, phone_prefixes: Sequence[str] = ()) -> tuple[Column, str, Column]:
    """Whether a value is valid by a rule (its own parameters unless overridden, else its pattern, else always), the note where it isn't and where it is."""
    text = F.coalesce(value, F.lit(""))
    if rule.id == "phone-validate":
        return validators.is_phone(text, phone_prefixes), validators.NOTES["phoneDigits"], F.lit("")
    if params is not None or rule.params is not None:
        return validators.validity(text, params if params is not None else rule.params)
    if rule.pattern:
        return regex.matches(text, rule.pattern), f"值不匹配规则 {rule.name}", F.lit("")
    return F.lit(True), "", F.lit("")


def verdict(value: Column, rule: Rule, params: dict[str, Any] | None = None, phone_prefixes: Sequence[str] = ()) -> Column:
    """struct<valid, note> of a value by a rule."""
    valid, bad, good = validity(value, rule, params, phone_prefixes)
    return F.struct(valid.alias("valid"), F.when(valid, good).otherwise(F.lit(bad)).alias("note"))


def _reason(field: str, bad: Column, text: Column) -> Column:
    return F.when(bad, F.struct(F.lit(field).alias("field"), text.alias("reason")))


def with_reasons(sheet: DataFrame, rules: Sequence[ColumnRule], phone_prefixes: Sequence[str] = ()) -> DataFrame:
    """The sheet with _reasons: what is wrong with each row, in the order of the rules, then of the comparisons.

    Each value is validated once: all verdicts are fields of one struct that the reasons are made from, as a
    projection of their own would be merged with what uses them, once for each use.
    """
    if not rules:
        raise InvalidInput("请至少选择一条校验规则")
    values: list[Column] = []  # verdicts and compared values
    makers: list[Callable[[Column], Column]] = []  # from the struct of them to a reason

    def held(value: Column) -> Callable[[Column], Column]:
        values.append(value)
        name = f"v{len(values) - 1}"
        return lambda own: own[name]

    def plain(field: str, valid: Callable[[Column], Column], note: str):
        return lambda own: _reason(field, ~valid(own), F.lit(note))

    idcard, births = None, {}
    for r in rules:
        check_column(sheet, r.column)
        valid, note, _ = validity(F.col(f"`{r.column}`"), r.rule, r.params, phone_prefixes)
        ok = held(valid)
        makers.append(plain(r.column, ok, note))
        tag = (r.params or r.rule.params or {}).get("validator")
        if tag in ("idcard", "idCard"):
            idcard = (held(F.coalesce(F.col(f"`{r.column}`"), F.lit(""))), ok)  # the last one holds
        if tag == "birth":
            births[r.column] = ok
    for r in rules:
        if r.cross_field is None or idcard is None:
            continue
        number, valid = idcard
        if r.cross_field.sex is not None:
            check_column(sheet, r.cross_field.sex)
            makers.append(_compared_sex(r.cross_field.sex, held(F.col(f"`{r.cross_field.sex}`")), number, valid))
        if r.cross_field.birth is not None:
            check_column(sheet, r.cross_field.birth)
            raw = F.coalesce(F.col(f"`{r.cross_field.birth}`"), F.lit(""))
            known = births.get(r.cross_field.birth) or held(validators.is_birth(raw))
            makers.append(_compared_birth(r.cross_field.birth, held(raw), known, number, valid))
    own = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return sheet.withColumn(REASONS, transforms.let(own, lambda v: F.array_compact(F.array(*[make(v) for make in makers]))).cast(_REASON))


def _compared_sex(field: str, sex: Callable[[Column], Column], number: Callable[[Column], Column], valid: Callable[[Column], Column]):
    def make(own: Column) -> Column:
        message = F.when(valid(own), validators.gender_mismatch(validators.idcard_gender(number(own)), sex(own)))
        return transforms.let(message, lambda m: _reason(field, m.isNotNull(), m))

    return make


def _compared_birth(field: str, raw: Callable[[Column], Column], known: Callable[[Column], Column], number: Callable[[Column], Column], valid: Callable[[Column], Column]):
    def make(own: Column) -> Column:
        born = F.substr(number(own), F.lit(7), F.lit(8))
        message = F.concat(F.lit("出生日期与身份证号不一致: 身份证"), born, F.lit("，出生日期"), raw(own))
        return _reason(field, valid(own) & known(own) & (validators.clean_birth(raw(own)) != born), message)

    return make


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid rows, with the columns and row numbers of the sheet."""
    columns = [ROW, *[c for c in headers(checked) if c != REASONS]]
    pick = [F.col(f"`{c}`") for c in columns]
    return checked.filter(F.size(REASONS) == 0).select(*pick), checked.filter(F.size(REASONS) > 0).select(*pick)


def reasons(checked: DataFrame) -> DataFrame:
    # an inner explode would have Spark test for empty arrays first, and so make every array twice
    found = checked.select(F.col(ROW).alias("source_row"), F.explode_outer(REASONS).alias("r"))
    return found.filter("r is not null").select("source_row", "r.field", "r.reason")


def reason_tally(found: DataFrame, top: int = 3) -> DataFrame:
    """The fields that fail most often; ties by name."""
    return found.groupBy("field").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "field").limit(top)
