"""Extraction: candidates by pattern, then a strict validator."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.errors import InvalidInput
from veilframe.functions import regex, transforms, validators
from veilframe.operators.columns import check_column
from veilframe.operators.sheet import ROW
from veilframe.plans.rules import IDCARD_ANY_FIRST_DIGIT, Rule

SUFFIX = "提取"
#: Of joined rows: code points of a stretch that is searched at once, and of the text around it that is searched too.
STRETCH, REACH = 32_768, 4096
_FIRST = -(2**63)  # below any row number
#: Rows whose lengths are summed as one.
BLOCK_ROWS = 10_000


def _prepared(rules: Sequence[Rule], phone_prefixes: Sequence[str], leading_zero: bool) -> list[Rule]:
    """Distinct rules in order, with what the caller overrides."""
    if not rules:
        raise InvalidInput("请至少选择一条提取规则")
    out = []
    for rule in {r.id: r for r in reversed(rules)}.values():
        if not rule.pattern:
            raise InvalidInput(f"规则 `{rule.id}` 缺少正则")
        tag = (rule.params or {}).get("validator")
        if rule.id == "phone-extract" and phone_prefixes:
            rule = replace(rule, params={"validator": "phonePrefix", "allowedPrefixes": list(phone_prefixes)})
        if tag in ("idcard", "idCard") and leading_zero:
            rule = replace(rule, pattern=IDCARD_ANY_FIRST_DIGIT)
        out.append(rule)
    order = list(dict.fromkeys(r.id for r in rules))
    return sorted(out, key=lambda r: order.index(r.id))


def candidates(text: Column, rules: Sequence[Rule]) -> Column:
    """array<struct<rule, pos, value>> of all rules' matches in a text: one scan serves every rule."""

    def own(k: int, rule: Rule) -> Column:
        hits = F.coalesce(regex.extract_all(text, rule.pattern), F.array().cast("array<string>"))
        return F.transform(hits, lambda x, i: F.struct(F.lit(k).alias("rule"), i.alias("pos"), x.alias("value")))

    found = [own(k, r) for k, r in enumerate(rules)]
    return F.concat(*found)


def extract(
    sheet: DataFrame, column: str, rules: Sequence[Rule], gender_column: str | None = None, phone_prefixes: Sequence[str] = (), idcard_allow_leading_zero: bool = False, joined: bool = False, reach: int = REACH
) -> DataFrame:
    """source_row, rule_ord, pos, type_label, value, valid, note of every candidate in a column.

    Candidates of a rule whose id card gender differs from the gender column of the row are invalid.
    Rows with a null text have none. Order is rule, row, place; it isn't imposed here.

    joined: the rows, in order of _row_idx, are pieces of one text without separators; a candidate is
    of the row in which it starts, and pos counts from there. See joined_text for `reach`.
    """
    check_column(sheet, column)
    rules = _prepared(rules, phone_prefixes, idcard_allow_leading_zero)
    gender = []
    if gender_column is not None:
        check_column(sheet, gender_column)
        gender = [F.col(f"`{gender_column}`").alias("_gender")]
    if joined:
        found = joined_candidates(sheet, column, rules, reach)
        if gender:
            found = found.join(sheet.select(F.col(ROW).alias("source_row"), *gender), "source_row", "left")
    else:
        found = sheet.select(ROW, *gender, F.explode(candidates(F.col(f"`{column}`"), rules)).alias("hit")).select(F.col(ROW).alias("source_row"), *(["_gender"] if gender else []), "hit.*")
    value = F.col("value")
    verdict = F.struct(F.lit(True).alias("valid"), F.lit("").alias("note"))
    label = F.lit("")
    for k, rule in reversed(list(enumerate(rules))):
        own = validators.validated(value, rule.params)
        if gender and (rule.params or {}).get("validator") in ("idcard", "idCard"):
            message = validators.gender_mismatch(validators.idcard_gender(value), F.col("_gender"))
            own = F.when(own["valid"] & message.isNotNull(), F.struct(F.lit(False).alias("valid"), message.alias("note"))).otherwise(own)
        verdict = F.when(F.col("rule") == k, own).otherwise(verdict)
        label = F.when(F.col("rule") == k, F.lit(rule.name.removesuffix(SUFFIX))).otherwise(label)
    return found.withColumn("_verdict", verdict).select("source_row", F.col("rule").alias("rule_ord"), "pos", label.alias("type_label"), "value", F.col("_verdict.valid").alias("valid"), F.col("_verdict.note").alias("note"))


def joined_text(sheet: DataFrame, column: str, reach: int = REACH, stretch: int = STRETCH) -> DataFrame:
    """The rows' texts as one, cut into overlapping stretches: _stretch, text, first (offset of its first code point), pieces (offset, row).

    A stretch is `stretch` code points of the whole text with `reach` more on both sides, so that what is
    found in it is found as in the whole text, as long as no match, and no run of matches that touch,
    is longer than `reach`. Offsets come from lengths summed by blocks of rows, one number a block;
    then each text moves once, cut at the edges of stretches, to as many tasks as there are stretches.
    """
    rows = sheet.select(ROW, F.col(f"`{column}`").alias("_text")).filter(F.octet_length("_text") > 0).withColumn("_block", F.floor(F.col(ROW) / BLOCK_ROWS))
    sizes = rows.groupBy("_block").agg(F.sum(F.char_length("_text")).alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))  # a row a block
    within = F.sum(F.char_length("_text")).over(Window.partitionBy("_block").orderBy(ROW)) - F.char_length("_text")
    placed = rows.withColumn("_within", within).join(before, "_block").withColumn("_at", F.col("_before") + F.col("_within"))
    size = F.char_length("_text")
    lowest, highest = F.floor((F.col("_at") - reach) / stretch), F.floor((F.col("_at") + size - 1 + reach) / stretch)
    dealt = placed.withColumn("_stretch", F.explode(F.sequence(F.greatest(lowest, F.lit(0)), highest)))
    low, high = F.col("_stretch") * stretch - reach, (F.col("_stretch") + 1) * stretch + reach
    skip = F.greatest(low - F.col("_at"), F.lit(0))
    part = F.substr("_text", (skip + 1).cast("int"), (F.least(high, F.col("_at") + size) - F.col("_at") - skip).cast("int"))
    parts = dealt.select("_stretch", F.struct((F.col("_at") + skip).alias("at"), F.col(ROW).alias("row"), part.alias("part")).alias("piece")).filter("length(piece.part) > 0")
    own = parts.groupBy("_stretch").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))  # stretch + 2 * reach code points at most
    return own.select("_stretch", F.array_join("pieces.part", "").alias("text"), F.col("pieces")[0]["at"].alias("first"), F.transform("pieces", lambda p: F.struct(p["at"].alias("at"), p["row"].alias("row"))).alias("pieces"))


def joined_candidates(sheet: DataFrame, column: str, rules: Sequence[Rule], reach: int = REACH, stretch: int = STRETCH) -> DataFrame:
    """source_row, rule, pos, value of all rules' matches in the joined rows."""

    def own(k: int, rule: Rule) -> Column:
        java = regex.checked(rule.pattern)
        place = lambda value, span: F.struct(F.lit(k).alias("rule"), (F.col("first") + span["start"]).alias("at"), value.alias("value"))
        found = transforms.with_matches(F.col("text"), java, lambda values, spans: F.zip_with(values, spans, place), F.char_length)
        inside = lambda x: (x["at"] >= F.col("_stretch") * stretch) & (x["at"] < (F.col("_stretch") + 1) * stretch)
        return F.when(F.col("text").rlike(java), F.filter(found, inside))

    hits = F.concat(*[F.coalesce(own(k, r), F.array().cast("array<struct<rule:int,at:bigint,value:string>>")) for k, r in enumerate(rules)])
    event = lambda at, row, rule, value: F.struct(at.alias("at"), rule.alias("rule"), row.alias("row"), value.alias("value"))

    def rowed(found: Column) -> Column:
        """The matches with their rows: pieces and matches in order of their places, and the last row that each place has reached."""
        pieces = F.transform("pieces", lambda p: event(p["at"], p["row"], F.lit(-1), F.lit("")))
        matches = F.transform(found, lambda x: event(x["at"], F.lit(_FIRST), x["rule"], x["value"]))
        with_rows = lambda all_: F.zip_with(all_, transforms.running(F.transform(all_, lambda e: e["row"]), F.lit(_FIRST), lambda a, b: F.greatest(a, b)), lambda e, row: event(e["at"], row, e["rule"], e["value"]))
        return F.filter(transforms.let(F.array_sort(F.concat(pieces, matches)), with_rows), lambda e: e["rule"] >= 0)

    found = transforms.let(hits, lambda own: F.when(F.size(own) > 0, rowed(own)))
    rowed_hits = joined_text(sheet, column, reach, stretch).select(F.explode(found).alias("hit"))
    rowed_hits = rowed_hits.select(F.col("hit.row").alias("source_row"), "hit.rule", "hit.at", "hit.value")
    place = F.row_number().over(Window.partitionBy("source_row", "rule").orderBy("at")) - 1
    return rowed_hits.select("source_row", "rule", place.alias("pos"), "value")


def extracted_sheet(found: DataFrame) -> DataFrame:
    """类型, 数据值 of the valid candidates, by rule, row and place."""
    return found.filter("valid").orderBy("rule_ord", "source_row", "pos").select(F.col("type_label").alias("类型"), F.col("value").alias("数据值"))


def rows_without_candidates(sheet: DataFrame, column: str, rules: Sequence[Rule], phone_prefixes: Sequence[str] = (), idcard_allow_leading_zero: bool = False, joined: bool = False, reach: int = REACH) -> DataFrame:
    """skipped: rows in which no rule finds anything (joined: in which nothing that is found starts). The rules are overridden as in extract."""
    rules = _prepared(rules, phone_prefixes, idcard_allow_leading_zero)
    if not joined:
        return sheet.select(F.count_if(F.coalesce(F.size(candidates(F.col(f"`{column}`"), rules)), F.lit(0)) <= 0).alias("skipped"))
    found = joined_candidates(sheet, column, rules, reach).select(F.col("source_row").alias(ROW)).distinct()
    return sheet.select(ROW).join(found, ROW, "left_anti").agg(F.count(F.lit(1)).alias("skipped"))


def summary(found: DataFrame) -> DataFrame:
    """Candidates and valid ones by type."""
    return found.groupBy("type_label").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("valid").alias("valid"))
