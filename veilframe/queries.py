"""Queries over the driver's tables, one per operator, each with the SQL that says the same."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import sinks
from veilframe.functions import masking, transforms, validators
from veilframe.operators import columns, extract, search, validate
from veilframe.operators import sheet as sheets
from veilframe.operators.sheet import ROW
from veilframe.plans.rules import PRESETS, Rule, RuleStore, Segment, SegmentTemplate, SimpleTemplate, built_in
from veilframe.plans.script import ScriptRunner
from veilframe.sources import archive, logs, pcap, plain
from veilframe.storage import fresh_path
from veilframe.workbench import Workbench

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = {r.id: r for r in built_in()}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_sheet(df: DataFrame, key: str, *names: str) -> DataFrame:
    """A table as a sheet: its key as row number, the named columns as text."""
    return df.select(F.col(key).cast("long").alias(ROW), *[F.col(n).cast("string").alias(n) for n in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_sheet(table(spark, sf_dir, "documents"), "doc_id", "text")


# extraction

_BANKCARD = r"\b[1-9]\d{12,18}\b"
_IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
_LUHN = """(length({v}) >= 2 AND list_sum(list_transform(range(1, length({v}) + 1), lambda i:
  CASE WHEN (length({v}) - i) % 2 = 0 THEN substr({v}, i, 1)::INT
       ELSE CASE WHEN substr({v}, i, 1)::INT > 4 THEN 2 * substr({v}, i, 1)::INT - 9 ELSE 2 * substr({v}, i, 1)::INT END END)) % 10 = 0)"""
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_OK = rf"regexp_full_match({{v}}, '{_OCTET}(\.{_OCTET}){{{{3}}}}')"


def _finds_sql(pattern: str) -> str:
    return f"""SELECT doc_id AS source_row, (i - 1)::INT AS pos, hits[i] AS value
FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits FROM documents), LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i)"""


def _verdict_sql(valid: str, label: str, note: str) -> str:
    return f"SELECT source_row, pos, '{label}' AS type_label, value, {valid} AS valid, CASE WHEN {valid} THEN '' ELSE '{note}' END AS note FROM"


_LUHN_V, _IP_V = _LUHN.format(v="value"), _IP_OK.format(v="value")
_CARDS_SQL = f"{_verdict_sql(_LUHN_V, '银行卡号', '未通过 Luhn 校验')} ({_finds_sql(_BANKCARD)})"
_IPS_SQL = f"{_verdict_sql(_IP_V, 'IPv4地址', '非合法 IPv4 地址')} ({_finds_sql(_IPV4)})"


@query(_CARDS_SQL)
def extract_bankcard_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(documents(spark, sf_dir), "text", [RULES["bankcard-extract"]]).drop("rule_ord")


@query(_IPS_SQL)
def extract_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(documents(spark, sf_dir), "text", [RULES["ip4-extract"]]).drop("rule_ord")


@query(f"SELECT 0 AS rule_ord, * FROM ({_CARDS_SQL}) UNION ALL SELECT 1 AS rule_ord, * FROM ({_IPS_SQL})")
def extract_multi_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(documents(spark, sf_dir), "text", [RULES["bankcard-extract"], RULES["ip4-extract"], RULES["bankcard-extract"]])


@query(f"SELECT type_label, count(*) AS candidates, count(*) FILTER (valid) AS valid FROM (({_CARDS_SQL}) UNION ALL ({_IPS_SQL})) GROUP BY type_label")
def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.summary(extract.extract(documents(spark, sf_dir), "text", [RULES["bankcard-extract"], RULES["ip4-extract"]]))


@query(f"SELECT count(*) FILTER (len(regexp_extract_all(text, '{_BANKCARD}')) = 0 AND len(regexp_extract_all(text, '{_IPV4}')) = 0) AS skipped FROM documents")
def extract_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.rows_without_candidates(documents(spark, sf_dir), "text", [RULES["bankcard-extract"], RULES["ip4-extract"]])


_EMAILS_SQL = r"SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+@-]+@[A-Za-z0-9.-]*')) AS email FROM documents"
_EMAIL_OK = r"(strlen(email) <= 254 AND regexp_full_match(email, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))"


@query(f"SELECT doc_id, email, {_EMAIL_OK} AS valid, CASE WHEN {_EMAIL_OK} THEN '' ELSE '邮箱格式不符' END AS note FROM ({_EMAILS_SQL})")
def validate_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._%+@-]+@[A-Za-z0-9.-]*"), F.lit(0))).alias("email"))
    own = validators.validated(F.col("email"), {"validator": "email"})
    return found.select("doc_id", "email", own["valid"].alias("valid"), own["note"].alias("note"))


# validators


def _checked(spark: SparkSession, sf_dir: str, name: str, key: str, made: dict) -> DataFrame:
    """key, and for each made column its value and validity."""
    out = table(spark, sf_dir, name).select(F.col(key), *[value.alias(c) for c, (value, _) in made.items()])
    return out.select(key, *made, *[validators.validated(F.col(c), params)["valid"].alias(f"{c}_ok") for c, (_, params) in made.items()])


@query(
    """SELECT p_partkey, p_name AS words, p_brand AS brand,
  regexp_full_match(p_name, '[A-Za-z ]+') AND length(p_name) BETWEEN 5 AND 30 AS words_ok,
  regexp_full_match(p_brand, '[0-9A-Za-z#]+') AND length(p_brand) <= 8 AS brand_ok FROM part"""
)
def validate_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"validator": "generic", "allowDigits": False, "allowLetters": True, "allowSpecialChars": " ", "minLen": 5, "maxLen": 30}
    brand = {"validator": "generic", "allowSpecialChars": "#", "maxLen": 8}
    return _checked(spark, sf_dir, "part", "p_partkey", {"words": (F.col("p_name"), words), "brand": (F.col("p_brand"), brand)})


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, regexp_full_match(c_name, '[A-Za-z0-9]+') AS name_ok, regexp_full_match(c_mktsegment, '[A-Za-z0-9]+') AS segment_ok FROM customer")
def validate_username(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, "customer", "c_custkey", {"name": (F.col("c_name"), {"validator": "username"}), "segment": (F.col("c_mktsegment"), {"validator": "username"})})


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dashed, strftime(o_orderdate, '%Y%d%m') AS swapped,
  year(o_orderdate) BETWEEN 1900 AND 2100 AS dashed_ok, year(o_orderdate) BETWEEN 1900 AND 2100 AND day(o_orderdate) <= 12 AS swapped_ok FROM orders"""
)
def validate_birth(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"dashed": (F.date_format("o_orderdate", "yyyy-MM-dd"), {"validator": "birth", "formats": ["yyyy/mm/dd", "yyyy-mm-dd"]}), "swapped": (F.date_format("o_orderdate", "yyyyddMM"), {"validator": "birth"})}
    return _checked(spark, sf_dir, "orders", "o_orderkey", made)


_ID_SUM = "(" + " + ".join(f"substr(base, {i}, 1)::INT * {w}" for i, w in enumerate(validators.ID_WEIGHTS, 1)) + ")"


@query(
    f"""SELECT o_orderkey, base || last AS idcard, last = substr('10X98765432', {_ID_SUM} % 11 + 1, 1) AS valid,
  CASE WHEN last <> substr('10X98765432', {_ID_SUM} % 11 + 1, 1) THEN '非合法身份证号' WHEN substr(base, 17, 1)::INT % 2 = 1 THEN '男' ELSE '女' END AS note
FROM (SELECT o_orderkey, (11010519490000000 + o_orderkey * 7919)::VARCHAR AS base, substr('10X98765432', (o_orderkey % 11)::INT + 1, 1) AS last FROM orders)"""
)
def validate_idcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = (F.lit(11010519490000000) + F.col("o_orderkey") * 7919).cast("string")
    last = F.substr(F.lit("10X98765432"), (F.col("o_orderkey") % 11).cast("int") + 1, F.lit(1))
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(base, last).alias("idcard"))
    own = validators.validated(F.col("idcard"), {"validator": "idcard"})
    return made.select("o_orderkey", "idcard", own["valid"].alias("valid"), own["note"].alias("note"))


@query(f"SELECT o_orderkey, digits, {_LUHN.format(v='digits')} AS digits_ok FROM (SELECT o_orderkey, (6222021234500000000 + o_orderkey * 31)::VARCHAR AS digits FROM orders)")
def validate_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, "orders", "o_orderkey", {"digits": ((F.lit(6222021234500000000) + F.col("o_orderkey") * 31).cast("string"), {"validator": "luhn"})})


@query("SELECT o_orderkey, phone, phone_ok AND (substr(phone, 1, 3) IN ('134', '139')) AS phone_ok FROM (SELECT o_orderkey, (13400000000 + o_orderkey * 99991)::VARCHAR AS phone, length((13400000000 + o_orderkey * 99991)::VARCHAR) = 11 AS phone_ok FROM orders)")
def validate_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, "orders", "o_orderkey", {"phone": ((F.lit(13400000000) + F.col("o_orderkey") * 99991).cast("string"), {"validator": "phonePrefix", "allowedPrefixes": ["134", "139"]})})


@query(f"SELECT l_orderkey, l_linenumber, ip, {_IP_OK.format(v='ip')} AS ip_ok FROM (SELECT l_orderkey, l_linenumber, (l_orderkey % 300) || '.' || (l_partkey % 256) || '.0' || l_linenumber || '.' || (l_suppkey % 260) AS ip FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, (l_orderkey % 300) || '.' || (l_partkey % 256) || '.' || l_linenumber || '.' || (l_suppkey % 260) FROM lineitem)")
def validate_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    texts = F.array(*[F.concat_ws(".", F.col("l_orderkey") % 300, F.col("l_partkey") % 256, F.concat(F.lit(zero), F.col("l_linenumber")), F.col("l_suppkey") % 260) for zero in ("0", "")])
    made = lines.select("l_orderkey", "l_linenumber", F.explode(texts).alias("ip"))
    return made.select("l_orderkey", "l_linenumber", "ip", validators.is_ipv4(F.col("ip")).alias("ip_ok"))


@query(
    """SELECT o_orderkey, address, (n BETWEEN 1 AND 1500) AND (s BETWEEN 101 AND 999) AS valid FROM
(SELECT o_orderkey, '北京市朝阳区' || (o_orderkey % 2000) || '号' || (o_orderkey % 1100) || '室' AS address, o_orderkey % 2000 AS n, o_orderkey % 1100 AS s FROM orders)"""
)
def validate_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    made = table(spark, sf_dir, "orders").select(key, F.concat(F.lit("北京市朝阳区"), key % 2000, F.lit("号"), key % 1100, F.lit("室")).alias("address"))
    return made.withColumn("valid", validators.validated(F.col("address"), {"validator": "address", "minHao": 1, "maxHao": 1500, "minShi": 101, "maxShi": 999})["valid"])


@query("SELECT c_custkey, sex, trim(sex) IN ('男', '女') AS sex_ok, CASE WHEN lower(trim(sex)) IN ('男', 'm') THEN '男' WHEN trim(sex) = '女' THEN '女' END AS normal FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '男' WHEN 1 THEN ' 女 ' WHEN 2 THEN 'M' ELSE '' END AS sex FROM customer)")
def validate_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    made = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, "男").when(k == 1, " 女 ").when(k == 2, "M").otherwise("").alias("sex"))
    return made.select("c_custkey", "sex", validators.is_sex(F.col("sex")).alias("sex_ok"), validators.normal_gender(F.col("sex")).alias("normal"))


@query("SELECT p_partkey, p_type, regexp_full_match(p_type, '[A-Z]+ [A-Z]+') AS valid, CASE WHEN regexp_full_match(p_type, '[A-Z]+ [A-Z]+') THEN '' ELSE '值不匹配规则 two words' END AS note FROM part")
def validate_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = validate.verdict(F.col("p_type"), Rule("two", "two words", "validate", pattern="^[A-Z]+ [A-Z]+$"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", own["valid"].alias("valid"), own["note"].alias("note"))


# rows by several rules


def _checked_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = as_sheet(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    rules = [
        validate.ColumnRule("c_name", RULES["generic-validate"], params={"validator": "generic", "allowSpecialChars": "#", "minLen": 9}),
        validate.ColumnRule("c_mktsegment", RULES["generic-validate"], params={"validator": "generic", "allowDigits": False, "maxLen": 9}),
        validate.ColumnRule("c_nationkey", RULES["generic-validate"], params={"validator": "generic", "allowLetters": False, "minLen": 2}),
    ]
    return validate.with_reasons(sheet, rules)


_NAME_BAD, _SEGMENT_BAD, _NATION_BAD = "NOT (regexp_full_match(c_name, '[A-Za-z0-9#]+') AND length(c_name) >= 9)", "NOT (regexp_full_match(c_mktsegment, '[A-Za-z]+') AND length(c_mktsegment) <= 9)", "length(c_nationkey::VARCHAR) < 2"
_REASONS_SQL = " UNION ALL ".join(
    f"SELECT c_custkey AS source_row, '{c}' AS field, '{note}' AS reason FROM customer WHERE {bad}"
    for c, bad, note in (("c_name", _NAME_BAD, "通用校验未通过（字符类或长度不符）"), ("c_mktsegment", _SEGMENT_BAD, "通用校验未通过（字符类或长度不符）"), ("c_nationkey", _NATION_BAD, "通用校验未通过（字符类或长度不符）"))
)
_ROW_SQL = "SELECT c_custkey AS _row_idx, c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer WHERE"


@query(f"{_ROW_SQL} NOT ({_NAME_BAD} OR {_SEGMENT_BAD} OR {_NATION_BAD})")
def validate_split_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.split(_checked_customers(spark, sf_dir))[0]


@query(f"{_ROW_SQL} ({_NAME_BAD} OR {_SEGMENT_BAD} OR {_NATION_BAD})")
def validate_split_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.split(_checked_customers(spark, sf_dir))[1]


@query(_REASONS_SQL)
def validate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reasons(_checked_customers(spark, sf_dir))


@query(f"SELECT field, count(*) AS count FROM ({_REASONS_SQL}) GROUP BY field ORDER BY count DESC, field LIMIT 3")
def validate_reason_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reason_tally(validate.reasons(_checked_customers(spark, sf_dir)))


# masks


def _masked(spark: SparkSession, sf_dir: str, name: str, key: str, column: str, rule: Rule | None) -> DataFrame:
    return table(spark, sf_dir, name).select(key, masking.mask(F.col(column), rule).alias("masked"))


def _template(template) -> Rule:
    return Rule("m", "m", "mask", template=template)


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 2 THEN repeat('*', length(c_name)) ELSE substr(c_name, 1, 1) || repeat('*', length(c_name) - 2) || substr(c_name, length(c_name), 1) END AS masked FROM customer")
def mask_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "customer", "c_custkey", "c_name", None)


@query("SELECT n_nationkey, CASE WHEN length(n_name) = 1 THEN '#' WHEN length(n_name) = 2 THEN substr(n_name, 1, 1) || '#' ELSE substr(n_name, 1, 1) || repeat('#', length(n_name) - 2) || substr(n_name, length(n_name), 1) END AS masked FROM nation")
def mask_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "nation", "n_nationkey", "n_name", Rule("n", "n", "mask", replacement="#"))


@query("SELECT c_custkey, CASE WHEN length(c_name) - 4 <= 3 THEN '****' ELSE substr(c_name, 1, 3) || repeat('*', greatest(length(c_name) - 7, 4)) || right(c_name, 4) END AS masked FROM customer")
def mask_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "customer", "c_custkey", "c_name", _template(PRESETS["phone"]))


@query("SELECT s_suppkey, CASE WHEN length(s_name) - 4 <= 3 THEN repeat('x', greatest(length(s_name), 1)) ELSE 'xxx' || substr(s_name, 4, length(s_name) - 7) || 'xxxx' END AS masked FROM supplier")
def mask_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "supplier", "s_suppkey", "s_name", _template(SimpleTemplate(3, 4, "x", 1, True)))


@query(
    """SELECT o_orderkey, CASE WHEN length(y) - 1 <= 1 THEN '**' ELSE substr(y, 1, 1) || repeat('*', greatest(length(y) - 2, 2)) || right(y, 1) END || '-' || m || '-***' AS masked
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m FROM orders)"""
)
def mask_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = _template(SegmentTemplate("-", (Segment(0, 1, 1, 2), Segment(2, 0, 2, 3), Segment(2, 9, 9, 9), Segment(7, 0, 0, 1)), "*"))
    dates = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return dates.select("o_orderkey", masking.mask(F.col("day"), rule).alias("masked"))


@query("SELECT c_custkey, CASE WHEN regexp_full_match(c_mktsegment, '[A-Z]{1,9}') THEN substr(c_mktsegment, 1, 1) || repeat('*', length(c_mktsegment) - 2) || right(c_mktsegment, 1) ELSE 'INVALID' END AS masked FROM customer")
def mask_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("c_mktsegment")
    valid = validators.validated(value, {"validator": "generic", "allowDigits": False, "maxLen": 9})["valid"]
    return table(spark, sf_dir, "customer").select("c_custkey", masking.validate_then_mask(value, valid).alias("masked"))


# transforms


@query("SELECT c_custkey, md5(c_name) AS md5, upper(sha1(c_name)) AS sha1, sha256(c_name) AS sha256 FROM customer")
def hash_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", *[transforms.digest(name, a, a == "sha1").alias(a) for a in ("md5", "sha1", "sha256")])


@query("SELECT doc_id, base64(encode(text)) AS encoded FROM documents")
def base64_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", transforms.base64_encode(F.col("text")).alias("encoded"))


@query("SELECT c_custkey, c_name AS decoded, NULL::VARCHAR AS refused FROM customer")
def base64_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = transforms.base64_encode(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", transforms.base64_decode(encoded).alias("decoded"), transforms.base64_decode(F.concat(encoded, F.lit("!"))).alias("refused"))


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low FROM part")
def case_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", transforms.change_case(F.col("p_name"), "upper").alias("up"), transforms.change_case(F.col("p_type"), "lower").alias("low"))


@query("SELECT o_orderkey, replace(o_orderpriority, '-', ' / ') AS literal, regexp_replace(o_orderpriority, '([0-9])-([A-Z])', '\\2\\1$', 'g') AS pattern FROM orders")
def replace_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", transforms.replace(value, "-", " / ").alias("literal"), transforms.replace(value, "(?P<digit>[0-9])-([A-Z])", "$2${digit}$$", True).alias("pattern"))


@query("SELECT count(*) FILTER (c_mktsegment LIKE '%BUILD%') AS affected, 0::BIGINT AS skipped FROM customer")
def replace_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.effect(as_sheet(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment"), "c_mktsegment", lambda c: transforms.replace(c, "BUILD", "MAKE"))


@query("SELECT s_suppkey AS _row_idx, replace(s_name, '0', 'o') AS s_name, replace(s_nationkey::VARCHAR, '0', 'o') AS s_nationkey FROM supplier")
def replace_in_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.replace_all(as_sheet(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "s_nationkey"), "0", "o")


@query("SELECT event_id AS source_row, json_extract_string(props, '$.k') AS k FROM events WHERE json_type(props) = 'OBJECT'")
def json_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.expand_json(as_sheet(table(spark, sf_dir, "events"), "event_id", "props"), "props")


# search


@query("SELECT p_partkey AS _row_idx, c.col_idx, c.value FROM (SELECT p_partkey, unnest([{'col_idx': 0, 'value': p_name}, {'col_idx': 1, 'value': p_type}]) AS c FROM part) WHERE contains(lower(c.value), 'bolt')")
def search_keyword_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_cells(as_sheet(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_type"), "BOLT")


@query("SELECT doc_id AS _row_idx, text FROM documents WHERE regexp_matches(text, '[0-9]{3}[.][0-9]+')")
def search_regex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_rows(documents(spark, sf_dir), r"[0-9]{3}\.\d+", use_regex=True)


@query("SELECT count(*) AS rows, sum(len(regexp_extract_all(text, 'the')))::BIGINT AS spans FROM documents WHERE contains(lower(text), 'the')")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_rows(documents(spark, sf_dir), "the")
    return found.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(transforms.keyword_spans(F.col("text"), "the"))).alias("spans"))


@query(
    """SELECT doc_id AS _row_idx, (i - 1)::INT AS at, (strlen(array_to_string(parts[1:i], '')) + 2 * (i - 1))::INT AS start, (strlen(array_to_string(parts[1:i], '')) + 2 * i)::INT AS "end"
FROM (SELECT doc_id, string_split(text, 'é ') AS parts FROM documents WHERE contains(text, 'é ')), LATERAL (SELECT unnest(range(1, len(parts))) AS i)""".replace("2 *", "3 *")
)
def search_keyword_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select(ROW, F.posexplode(transforms.keyword_spans(F.col("text"), "é ")).alias("at", "span"))
    return found.select(ROW, "at", "span.start", "span.end")


@query(
    r"""SELECT doc_id AS _row_idx, (i - 1)::INT AS at, (length(array_to_string(parts[1:i], '')) + length(array_to_string(hits[1:i-1], '')))::INT AS start_char FROM
(SELECT doc_id, string_split_regex(text, '[0-9]{4,}') AS parts, regexp_extract_all(text, '[0-9]{4,}') AS hits FROM documents WHERE regexp_matches(text, '[0-9]{4,}')),
LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i)"""
)
def search_regex_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = transforms.pattern_spans(F.col("text"), "[0-9]{4,}")
    found = documents(spark, sf_dir).select(ROW, "text", F.posexplode(spans).alias("at", "span"))
    head = F.expr("decode(substring(cast(text as binary), 1, span.start), 'UTF-8')")
    return found.select(ROW, "at", F.char_length(head).alias("start_char"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS _row_idx, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")
def sheet_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select("p_name")
    return sheets.page(sheets.number_rows(rows, in_files=False), 3, 50)


@query("SELECT n_nationkey AS _row_idx, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def cells_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = as_sheet(table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "n_regionkey")
    return sheets.wide(sheets.cells(nations), sheets.headers(nations))


@query("SELECT o_orderkey AS _row_idx, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def rows_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias(ROW))
    return sheets.select_rows(as_sheet(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus"), wanted)


@query(
    """SELECT 'region' AS __table, r_regionkey::VARCHAR AS r_regionkey, r_name, '' AS n_nationkey, '' AS n_name, '' AS n_regionkey FROM region
UNION ALL SELECT 'nation', '', '', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR FROM nation"""
)
def union_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.union_by_name([(n, table(spark, sf_dir, n)) for n in ("region", "nation")], "__table")


# exports


@query("SELECT 0::BIGINT AS _row_idx, chr(65279) || 'p_name;p_brand' AS line UNION ALL SELECT p_partkey, p_name || ';' || p_brand FROM part")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_lines(as_sheet(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand"), sep=";")


@query("""SELECT c_custkey AS _row_idx, '{"c_name":"' || c_name || '","c_nationkey":"' || c_nationkey || '"}' AS line FROM customer""")
def export_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_objects(as_sheet(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_nationkey"))


@query("""SELECT n_nationkey::BIGINT AS _row_idx, "at", line FROM (SELECT n_nationkey, 0 AS "at", 'n_name=' || n_name AS line FROM nation UNION ALL SELECT n_nationkey, 1, 'n_regionkey=' || n_regionkey FROM nation)""")
def export_text_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.text_lines(as_sheet(table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "n_regionkey"), "{name}={值}")


@query("SELECT s_suppkey AS _row_idx, 0 AS at, s_name || ' of ' || s_nationkey || '!' AS line FROM supplier")
def export_text_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.text_lines(as_sheet(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "s_nationkey"), "{s_name} of {s_nationkey}!{unknown}")


@query(
    """SELECT o_orderkey + 1 AS _row_idx, CASE WHEN o_orderkey % 3 = 0 THEN 'INVALID' ELSE '134####' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') END AS phone, md5(o_orderpriority) AS priority FROM orders"""
)
def workbench_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column masked by a template of the moment, values that a rule refuses marked; another digested."""
    key = F.col("o_orderkey")
    phone = F.when(key % 3 == 0, F.lit("no phone")).otherwise(F.concat(F.lit("1340000"), F.lpad((key % 10000).cast("string"), 4, "0")))
    bench = Workbench(spark, fresh_path(spark, "bench"))
    sheet = bench.add_sheet(1, "orders", table(spark, sf_dir, "orders").select((key + 1).alias(ROW), phone.alias("phone"), F.col("o_orderpriority").alias("priority")))
    bench.mask(sheet, "phone", replacement="#", template={"keepPrefix": 3, "keepSuffix": 4}, validate_rule_id="phone-validate")
    bench.hash(sheet, "priority", "md5")
    return bench.data(sheet)


@query(
    """WITH hits AS (SELECT p_partkey, i, CASE i WHEN 0 THEN p_name ELSE p_type END AS value FROM part, LATERAL (SELECT unnest([0, 1]) AS i)),
found AS (SELECT * FROM hits WHERE contains(lower(value), 'bolt'))
SELECT p_partkey AS _row_idx, i::INT AS col_idx, value, (SELECT count(*) FROM found) AS total FROM found ORDER BY p_partkey, i LIMIT 20 OFFSET 20"""
)
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of what a search finds, with the number of all finds, from one job."""
    rows, total = search.result_page(search.search_cells(as_sheet(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_type"), "BOLT"), [ROW, "col_idx"], 2, 20)
    return spark.createDataFrame([(*r, total) for r in rows], f"{ROW} long, col_idx int, value string, total long")


@query(
    """WITH sheet AS (SELECT row_number() OVER (ORDER BY c_custkey) AS _row_idx, c_nationkey::VARCHAR AS c_nationkey, c_name FROM customer)
SELECT _row_idx, c_nationkey, c_name, (SELECT count(*) FROM sheet) AS total FROM sheet WHERE _row_idx BETWEEN 41 AND 60"""
)
def import_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file imported into a workbench; the third page of 20 rows, two of its columns in an order of their own, and the number of rows."""
    bench = Workbench(spark, fresh_path(spark, "bench"))
    made = bench.import_file(_csv_file(spark, as_sheet(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_mktsegment", "c_nationkey")), format="csv")
    page = sheets.page(sheets.project(bench.data(made["sheet_id"]), ["c_nationkey", "c_name"]), 3, 20)
    return page.withColumn("total", F.lit(bench.page(made["sheet_id"], 3, 20)["total"]).cast("long"))


@query(
    """SELECT * FROM (SELECT p_partkey AS _row_idx, i::INT AS col_idx, CASE i WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END AS value FROM part, LATERAL (SELECT unnest([0, 1, 2]) AS i))
WHERE regexp_matches(value, '(^|[^a-z])[bB][a-z]+[0-9]*$')"""
)
def search_regex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_cells(as_sheet(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand", "p_type"), r"(^|[^a-z])[bB][a-z]+\d*$", use_regex=True)


@query(
    """SELECT o_orderkey AS source_row, pos::INT AS pos, ((CASE pos WHEN 0 THEN 19900000000 ELSE 13400000000 END) + o_orderkey)::VARCHAR AS value, pos = 0 AS valid FROM orders, LATERAL (SELECT unnest([0, 1]) AS pos)"""
)
def extract_phone_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers of prefixes named for the occasion."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("call "), (key + 19900000000).cast("string"), F.lit(" or "), (key + 13400000000).cast("string"), F.lit("."))
    made = table(spark, sf_dir, "orders").select(key.alias(ROW), text.alias("memo"))
    found = extract.extract(made, "memo", [RULES["phone-extract"]], phone_prefixes=validators.phone_prefixes(["199"]))
    return found.select("source_row", "pos", "value", "valid")


# SQL, which scripts bring


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


_JOIN = "SELECT n_name, count(*) AS customers, count(DISTINCT o_orderkey) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name"
_ROLLUP = "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"
_WINDOW = "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS number, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders"
_SETS = "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1"
_SEMI = "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"


def _sql(text: str, *names: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir, *names)
        return spark.sql(text)

    return run


for _name, _text, _tables in (
    ("sql_join_aggregate", _JOIN, ("nation", "customer", "orders")),
    ("sql_rollup", _ROLLUP, ("lineitem",)),
    ("sql_window", _WINDOW, ("orders",)),
    ("sql_set_operations", _SETS, ("customer", "supplier", "nation")),
    ("sql_semi_anti", _SEMI, ("customer", "orders")),
):
    QUERIES[_name], ORACLE_SQL[_name] = _sql(_text, *_tables), _text


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def top_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).orderBy(F.desc("n"), "event_type").limit(5)


@query("SELECT c_custkey, c_name AS after_undo, md5(c_name) AS after_redo FROM customer")
def undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest that a workbench undoes and does again."""
    bench = Workbench(spark, fresh_path(spark, "bench"))
    sheet = bench.add_sheet(1, "customer", as_sheet(table(spark, sf_dir, "customer"), "c_custkey", "c_name"))
    bench.hash(sheet, "c_name", "md5")
    operation = bench.undoable(sheet)[0]["id"]
    bench.undo(operation)
    undone = bench.data(sheet)
    bench.redo(operation)
    redone = bench.data(sheet)
    return undone.select(F.col(ROW).alias("c_custkey"), F.col("c_name").alias("after_undo")).join(redone.select(F.col(ROW).alias("c_custkey"), F.col("c_name").alias("after_redo")), "c_custkey")


_LAST_EDITS = """WITH edits AS (SELECT o_custkey + 1 + CASE WHEN o_orderkey % 50 = 0 THEN 1000000 ELSE 0 END AS r, CASE WHEN o_orderkey % 2 = 0 THEN 'c_name' ELSE 'c_mktsegment' END AS col, CASE WHEN o_orderkey % 7 > 0 THEN 'order ' || o_orderkey END AS v, o_orderkey AS k FROM orders),
last AS (SELECT r, col, (arg_max({'v': v}, k)).v AS v FROM edits GROUP BY r, col),
sheet AS (SELECT c_custkey + 1 AS r, c_name, c_mktsegment FROM customer UNION ALL SELECT DISTINCT r, NULL, NULL FROM last WHERE r NOT IN (SELECT c_custkey + 1 FROM customer))
"""


def _edited_customers(spark: SparkSession, sf_dir: str) -> tuple[Workbench, int]:
    """Customers with cells put in from orders: cells several times, customers that aren't there, nulls."""
    bench = Workbench(spark, fresh_path(spark, "bench"))
    sheet = bench.add_sheet(1, "customer", as_sheet(table(spark, sf_dir, "customer").withColumn("row", F.col("c_custkey") + 1), "row", "c_name", "c_mktsegment"))
    key = F.col("o_orderkey")
    edits = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") + 1 + F.when(key % 50 == 0, 1000000).otherwise(0)).alias(ROW), F.when(key % 2 == 0, "c_name").otherwise("c_mktsegment").alias("column"),
        F.when(key % 7 > 0, F.concat(F.lit("order "), key)).alias("value"), key.alias("_at"),
    )
    bench.hash(sheet, "c_name", "sha1")
    bench.write_cells(sheet, edits)
    return bench, sheet


@query(f"{_LAST_EDITS} SELECT s.r AS _row_idx, CASE WHEN n.r IS NULL THEN sha1(c_name) ELSE n.v END AS c_name, CASE WHEN m.r IS NULL THEN c_mktsegment ELSE m.v END AS c_mktsegment FROM sheet s LEFT JOIN last n ON n.r = s.r AND n.col = 'c_name' LEFT JOIN last m ON m.r = s.r AND m.col = 'c_mktsegment'")
def cell_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench, sheet = _edited_customers(spark, sf_dir)
    return bench.data(sheet)


@query(f"{_LAST_EDITS} SELECT s.r AS _row_idx, CASE WHEN s.c_name IS NOT NULL THEN s.c_name ELSE n.v END AS c_name, CASE WHEN m.r IS NULL THEN c_mktsegment ELSE m.v END AS c_mktsegment FROM sheet s LEFT JOIN last n ON n.r = s.r AND n.col = 'c_name' LEFT JOIN last m ON m.r = s.r AND m.col = 'c_mktsegment'")
def cell_edits_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After compaction the digest before the edits is undone: names that it changed come back, other cells stay as edited."""
    bench, sheet = _edited_customers(spark, sf_dir)
    bench.compact(sheet)
    bench.undo(next(o["id"] for o in bench.undoable(sheet) if o["kind"] == "hash"))
    return bench.data(sheet)


@query(
    """SELECT p_partkey AS _row_idx, c.col_idx, c.value, (len(string_split(c.value, 'bolt')) - 1)::INT AS places, CASE WHEN contains(c.value, 'bolt') THEN (strpos(c.value, 'bolt') - 1)::INT END AS first_start
FROM (SELECT p_partkey, unnest([{'col_idx': 0, 'value': p_name}, {'col_idx': 1, 'value': p_type}]) AS c FROM part) WHERE contains(lower(c.value), 'bolt')"""
)
def search_rows_with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows found by a keyword, all their cells that hold it, and its places in them (in its own case)."""
    parts = as_sheet(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_type")
    found = search.with_hits(search.search_rows(parts, "bolt"), "bolt").select(ROW, F.explode("hits").alias("hit")).select(ROW, "hit.*")
    return found.select(ROW, "col_idx", "value", F.size("matches").alias("places"), F.get("matches", F.lit(0))["start"].alias("first_start"))


@query("SELECT 2 * o_orderkey - 1 AS source_row, 0 AS rule_ord, 0 AS pos, '手机号' AS type_label, (13400000000 + o_orderkey * 99991)::VARCHAR AS value, length((13400000000 + o_orderkey * 99991)::VARCHAR) = 11 AS valid, '' AS note FROM orders WHERE (13400000000 + o_orderkey * 99991) < 100000000000")
def extract_joined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that lie across the rows of a text."""
    number = (F.lit(13400000000) + F.col("o_orderkey") * 99991).cast("string")
    halves = F.array(F.struct(F.lit(1).alias("at"), F.concat(F.lit("to "), F.substring(number, 1, 5)).alias("content")), F.struct(F.lit(0).alias("at"), F.concat(F.substring(number, 6, 20), F.lit(" and ")).alias("content")))
    pieces = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(halves).alias("piece")).select((F.col("o_orderkey") * 2 - F.col("piece.at")).alias(ROW), "piece.content")
    return extract.extract(pieces, "content", [RULES["phone-extract"]], joined=True)


@query(
    """SELECT o_orderkey, ip, ok FROM (SELECT o_orderkey, printf('2001:db8::%x', o_orderkey) AS ip, o_orderkey < 65536 AS ok FROM orders UNION ALL SELECT o_orderkey, printf('1:2:3:4:5:6:7:%x', o_orderkey % 70000), o_orderkey % 70000 < 65536 FROM orders
UNION ALL SELECT o_orderkey, printf('%x::1::2', o_orderkey % 999), false FROM orders UNION ALL SELECT o_orderkey, printf('::ffff:10.0.%d.1', o_orderkey % 300), o_orderkey % 300 < 256 FROM orders)"""
)
def validate_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    low = lambda c: F.lower(F.hex(c))
    forms = F.array(F.concat(F.lit("2001:db8::"), low(key)), F.concat(F.lit("1:2:3:4:5:6:7:"), low(key % 70000)), F.concat(low(key % 999), F.lit("::1::2")), F.concat(F.lit("::ffff:10.0."), (key % 300).cast("string"), F.lit(".1")))
    made = table(spark, sf_dir, "orders").select(key, F.explode(forms).alias("ip"))
    return made.select("o_orderkey", "ip", validators.validated(F.col("ip"), {"validator": "ipv6"})["valid"].alias("ok"))


@query("SELECT p_partkey AS _row_idx, p_brand AS value FROM part WHERE p_partkey BETWEEN 41 AND 70")
def sheet_column_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.column_page(as_sheet(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand"), "p_brand", 40, 30)


_KINDS = {"extract": ("bankcard", "idcard", "ip4", "ip6", "name", "phone"), "mask": ("name", "segment", "simple"), "validate": ("address", "birth", "email", "generic", "idcard", "name", "phone", "sex", "username")}


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{n}-{kind}', '{kind}', {str((n, kind) != ('ip6', 'extract')).lower()}, {'NULL' if (n, kind) != ('name', 'mask') else repr('#')})" for kind, names in _KINDS.items() for n in names)
    + ", ('own', 'mask', true, '*')) AS t(rule_id, kind, enabled, replacement)"
)
def rule_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a store: those it starts with, one switched off, one changed, one added; by way of their JSON form."""
    store = RuleStore()
    store.toggle("ip6-extract", False)
    store.update_params("name-mask", replacement="#")
    store.register(Rule("own", "own", "mask", replacement="*"))
    rules = [Rule.from_json(r.to_json()) for r in store.list()]
    return spark.createDataFrame([(r.id, r.kind, r.enabled, r.replacement) for r in rules], "rule_id string, kind string, enabled boolean, replacement string")


# sources and sinks, by way of files in the shared folder


def _file(spark: SparkSession, lines: DataFrame, kind: str, eol: str = "\n") -> str:
    path = fresh_path(spark, kind)
    sinks.write_lines(lines, path, eol)
    return path


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS _row_idx, c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export as CSV, import again."""
    made = as_sheet(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return plain.read_csv(spark, _csv_file(spark, made))


def _csv_file(spark: SparkSession, sheet: DataFrame) -> str:
    """CSV files that follow each other, each with headers."""
    body, path = sinks.csv_lines(sheet, header=False), fresh_path(spark, "csv")
    ordered = body.repartitionByRange(ROW).sortWithinPartitions(ROW)
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # of a part
    ordered.select(F.when(first, F.concat(F.lit(",".join(sheets.headers(sheet)) + "\r\n"), "line")).otherwise(F.col("line")).alias("line")).write.option("lineSep", "\r\n").text(path)
    return path


@query(
    """SELECT row_number() OVER (ORDER BY c_custkey) AS _row_idx, 'a"b,' || c_name AS first, c_mktsegment || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '"' ELSE '' END || c_custkey AS second, CASE WHEN c_custkey % 5 > 0 THEN 'c"d' END AS third FROM customer"""
)
def source_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that go over several lines, with quotes in all places."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    second = F.concat("c_mktsegment", F.lit("\n"), F.when(key % 3 == 0, F.lit('\n"')).otherwise(""), key.cast("string"))
    made = c.select(key.alias(ROW), F.concat(F.lit('a"b,'), "c_name").alias("first"), second.alias("second"), F.when(key % 5 > 0, 'c"d').alias("third"))
    return plain.read_csv(spark, _csv_file(spark, made))


@query("""SELECT row_number() OVER (ORDER BY o_orderkey) AS _row_idx, 'a } ] "' || o_orderkey AS "key", CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS priority, '{"status":"' || o_orderstatus || '"}' AS nested FROM orders""")
def source_json_array_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array without line breaks, in one file."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    item = F.to_json(F.struct(F.concat(F.lit('a } ] "'), key.cast("string")).alias("key"), F.when(key % 4 > 0, F.col("o_orderpriority")).alias("priority"), F.struct(F.col("o_orderstatus").alias("status")).alias("nested")))
    last = o.agg(F.max("o_orderkey")).first()[0]
    line = F.concat(F.when(key == o.agg(F.min("o_orderkey")).first()[0], "[").otherwise(""), item, F.when(key == last, "]").otherwise(","))
    path = fresh_path(spark, "json")
    o.select(key.alias(ROW), line.alias("line")).coalesce(1).sortWithinPartitions(ROW).select("line").write.option("lineSep", " ").text(path)
    return plain.read_json(spark, path)


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS _row_idx, p_name, p_size::VARCHAR AS p_size FROM part")
def source_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = as_sheet(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_size")
    return plain.read_json(spark, _file(spark, sinks.json_objects(made), "jsonl"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS _row_idx, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def source_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = as_sheet(table(spark, sf_dir, "nation").withColumn("row", F.col("n_nationkey") + 1), "row", "n_name", "n_regionkey")
    path = fresh_path(spark, "json")
    sinks.write_lines(sinks.json_array_lines(made), path, "\n", single_file=True)
    return plain.read_json(spark, path)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS _row_idx, o_orderpriority || ' ' || o_orderkey AS content FROM orders")
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW), F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("line"))
    return plain.read_txt(spark, _file(spark, made, "txt", "\r\n"))


_LOG = """'10.0.' || (user_id % 256) || '.' || (event_id % 256) || ' - u' || user_id || ' [' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] "GET /' || event_type || ' HTTP/1.1" ' || (200 + event_id % 5) || ' ' || CASE WHEN event_id % 3 = 0 THEN '-' ELSE event_id::VARCHAR END || ' "-" "agent ' || event_id || '"'"""


@query(
    f"""SELECT row_number() OVER (ORDER BY event_id) AS _row_idx, '10.0.' || (user_id % 256) || '.' || (event_id % 256) AS remote_host, '-' AS ident, 'u' || user_id AS remote_user, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_local,
  'GET' AS request_method, '/' || event_type AS request_url, 'HTTP/1.1' AS request_protocol, (200 + event_id % 5)::VARCHAR AS status,
  CASE WHEN event_id % 3 = 0 THEN '0' ELSE event_id::VARCHAR END AS body_bytes_sent, '-' AS http_referer, 'agent ' || event_id AS http_user_agent, {_LOG} AS raw_line FROM events"""
)
def source_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = lambda c: F.col(c).cast("string")
    sent = F.when(F.col("event_id") % 3 == 0, "-").otherwise(text("event_id"))
    line = F.concat(
        F.lit("10.0."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 256, F.lit(" - u"), text("user_id"), F.lit(" ["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('] "GET /'), "event_type",
        F.lit(' HTTP/1.1" '), 200 + F.col("event_id") % 5, F.lit(" "), sent, F.lit(' "-" "agent '), text("event_id"), F.lit('"'),
    )
    return logs.read_log(spark, _file(spark, e.select(F.col("event_id").alias(ROW), line.alias("line")), "log"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) AS _row_idx, s_suppkey::VARCHAR AS frame_no, '10.0.0.1' AS src_ip, '' AS dst_ip, 'POST' AS method, s_name AS host, '/' AS uri, s_name AS body, '' AS user_agent FROM supplier")
def source_dissected(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.hex(F.col("s_name").cast("binary"))
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(ROW), F.concat_ws("\t", F.col("s_suppkey"), F.lit("10.0.0.1"), F.lit(""), F.lit("POST"), F.col("s_name"), F.lit("/"), body).alias("line"))
    return pcap.read_dissected(spark, _file(spark, made, "tsv"))


@query("SELECT 'AMERICA' AS name, '3' AS n, '' AS total UNION ALL SELECT 'asia', '7', '' UNION ALL SELECT '', '', '10'")
def source_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script: what changes tables runs first, then the queries, united by column name."""
    script = """CREATE TABLE r (name TEXT, n INT); INSERT INTO r VALUES ('AMERICA', 3), ('ASIA', 4), ('GONE', 1);
    SELECT name, n FROM r; SELECT sum(n) AS total FROM r; UPDATE r SET n = n + 3, name = lower(name) WHERE name = 'ASIA'; DELETE FROM r WHERE n < 2;"""
    return ScriptRunner(spark).script(script).result


@query(
    """SELECT n_name, count(*) AS customers, CAST(sum(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS marked, 'unknown' AS grade, '' AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 > 0 GROUP BY n_name
UNION ALL SELECT '', NULL, NULL, '', (SELECT count(*) FROM customer WHERE c_custkey % 3 > 0)::VARCHAR"""
)
def script_over_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script that makes, changes and joins tables of what the given ones hold."""
    runner = ScriptRunner(spark)
    for name in ("customer", "nation"):
        runner.add(name, table(spark, sf_dir, name))
    script = """CREATE TABLE own (id INT PRIMARY KEY, place INT, mark INT, grade TEXT DEFAULT 'unknown');
    INSERT INTO own (id, place, mark) SELECT c_custkey, c_nationkey, 0 FROM customer; UPDATE own SET mark = 1 WHERE id % 4 = 0; DELETE FROM own WHERE id % 3 = 0;
    CREATE TABLE found AS SELECT n_name, place, mark, grade FROM own JOIN nation ON place = n_nationkey; ALTER TABLE found RENAME COLUMN mark TO marked;
    SELECT n_name, count(*) AS customers, sum(marked) AS marked, min(grade) AS grade FROM found GROUP BY n_name; SELECT count(*) AS total FROM found;"""
    found = runner.script(script).result
    return found.select("n_name", *[F.nullif(c, F.lit("")).cast("long").alias(c) for c in ("customers", "marked")], "grade", "total")


_PAIRED = "SELECT o_orderkey, '110105' || strftime(o_orderdate, '%Y%m%d') || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS base, strftime(o_orderdate + INTERVAL (o_orderkey % 2) DAY, '%Y-%m-%d') AS birth, CASE WHEN o_orderkey % 3 = 0 THEN '女' ELSE 'male' END AS sex FROM orders"
_PAIRED_ID = f"SELECT o_orderkey, base || substr('10X98765432', {_ID_SUM} % 11 + 1, 1) AS idcard, birth, sex FROM ({_PAIRED})"


@query(
    f"""WITH d AS (SELECT *, CASE WHEN substr(idcard, 17, 1)::INT % 2 = 1 THEN '男' ELSE '女' END AS g FROM ({_PAIRED_ID}))
SELECT o_orderkey AS source_row, 'sex' AS field, '性别不一致: 身份证推断' || g || '，性别列' || sex AS reason FROM d WHERE g <> CASE WHEN sex = '女' THEN '女' ELSE '男' END
UNION ALL SELECT o_orderkey, 'birth', '出生日期与身份证号不一致: 身份证' || substr(idcard, 7, 8) || '，出生日期' || birth FROM d WHERE replace(birth, '-', '') <> substr(idcard, 7, 8)"""
)
def validate_cross_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id card against the sex and birth columns of its row."""
    key = F.col("o_orderkey")
    base = F.concat(F.lit("110105"), F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((key % 1000).cast("string"), 3, "0"))
    birth = F.date_format(F.date_add(F.to_date("o_orderdate"), (key % 2).cast("int")), "yyyy-MM-dd")
    made = table(spark, sf_dir, "orders").select(key.alias(ROW), base.alias("base"), birth.alias("birth"), F.when(key % 3 == 0, "女").otherwise("male").alias("sex"))
    own = made.select(ROW, F.concat("base", validators.idcard_check(F.col("base"))).alias("idcard"), "birth", "sex")
    rule = validate.ColumnRule("idcard", RULES["idcard-validate"], validate.CrossField("sex", "birth"))
    return validate.reasons(validate.with_reasons(own, [rule]))


def _put(spark: SparkSession, path: str, data: bytes) -> str:
    """Bytes that the driver made, as a file in the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()
    return path


@query(
    """SELECT row_number() OVER (ORDER BY __table, k) AS _row_idx, __table, n_nationkey, n_name, share, r_regionkey, r_name FROM (
SELECT 'nation' AS __table, n_nationkey AS k, n_nationkey::VARCHAR AS n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey // 2)::VARCHAR ELSE (n_nationkey // 2)::VARCHAR || '.5' END AS share, '' AS r_regionkey, '' AS r_name FROM nation
UNION ALL SELECT 'region', r_regionkey, '', '', '', r_regionkey::VARCHAR, r_name FROM region)"""
)
def source_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database of two tables that don't grow."""
    made = sqlite3.connect(":memory:")
    made.execute("CREATE TABLE region (r_regionkey INTEGER, r_name TEXT)")
    made.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, share REAL)")
    made.executemany("INSERT INTO region VALUES (?, ?)", [(r["r_regionkey"], r["r_name"]) for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()])
    made.executemany("INSERT INTO nation VALUES (?, ?, ?)", [(r["n_nationkey"], r["n_name"], r["n_nationkey"] / 2) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()])
    made.commit()
    return archive.read_sqlite(spark, _put(spark, fresh_path(spark, "database") + ".db", made.serialize()))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS _row_idx, n_nationkey::VARCHAR AS key, n_name AS name, strftime(DATE '2024-01-01' + n_nationkey::INT, '%Y-%m-%d') AS day FROM nation")
def source_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook whose first sheet is not its first file, with dates."""
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    text = lambda t: f'<c t="inlineStr"><is><t>{t}</t></is></c>'
    rows = ["".join(map(text, ("key", "name", "day")))]
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        rows.append(f'<c><v>{r["n_nationkey"]}</v></c>{text(r["n_name"])}<c s="1"><v>{45292 + r["n_nationkey"]}</v></c>')
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="nations" sheetId="2" r:id="b"/><sheet name="empty" sheetId="1" r:id="a"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"/>')
        book.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(f"<row>{r}</row>" for r in rows)}</sheetData></worksheet>')
    return archive.read_xlsx(spark, _put(spark, fresh_path(spark, "workbook") + ".xlsx", held.getvalue()))


@query(
    """WITH t AS (SELECT repeat(string_agg(n_name || '-', '' ORDER BY n_nationkey), 60) AS text FROM nation)
SELECT i::BIGINT AS _row_idx, substr(text, 4096 * (i - 1) + 1, 4096) AS content FROM t, LATERAL (SELECT unnest(range(1, (length(text) + 4095) // 4096 + 1)) AS i)"""
)
def source_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of one line, cut on import."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: F.concat(n["n_name"], F.lit("-"))), "")  # 25 names
    made = table(spark, sf_dir, "nation").agg(F.repeat(names, 60).alias("line")).select(F.lit(1).alias(ROW), "line")
    return plain.read_txt(spark, _file(spark, made, "txt"))


def _events(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """Events as log lines, read again."""
    return logs.read_log(spark, _file(spark, table(spark, sf_dir, "events").select(F.col("event_id").alias(ROW), line.alias("line")), "log"))


_COMMON = """'h' || user_id || ' - - [' || strftime(ts, '%d/%m/%Y:%H:%M:%S') || '] "GET /' || event_type || ' HTTP/1.1" 200 ' || event_id"""


@query(f"SELECT row_number() OVER (ORDER BY event_id) AS _row_idx, 'h' || user_id AS remote_host, '-' AS ident, '-' AS remote_user, strftime(ts, '%d/%m/%Y:%H:%M:%S') AS time_local, 'GET' AS request_method, '/' || event_type AS request_url, 'HTTP/1.1' AS request_protocol, '200' AS status, event_id::VARCHAR AS body_bytes_sent, {_COMMON} AS raw_line FROM events")
def source_log_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "dd/MM/yyyy:HH:mm:ss")
    return _events(spark, sf_dir, F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(" - - ["), stamp, F.lit('] "GET /'), "event_type", F.lit(' HTTP/1.1" 200 '), F.col("event_id").cast("string")))


_PID = "CASE WHEN event_id % 2 = 0 THEN '[' || event_id || ']' ELSE '' END"


@query(f"SELECT row_number() OVER (ORDER BY event_id) AS _row_idx, strftime(ts, '%b %d %H:%M:%S') AS timestamp, 'node' || user_id AS host, event_type AS process, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE '' END AS pid, 'value of ' || user_id AS message, strftime(ts, '%b %d %H:%M:%S') || ' node' || user_id || ' ' || event_type || {_PID} || ': value of ' || user_id AS raw_line FROM events")
def source_log_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, pid = F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))).otherwise("")
    return _events(spark, sf_dir, F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" node"), user, F.lit(" "), "event_type", pid, F.lit(": value of "), user))


@query("SELECT row_number() OVER (ORDER BY event_id) AS _row_idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN event_id % 3 = 0 THEN 'WARN' ELSE 'INFO' END AS level, 't' || user_id AS thread, event_type || ' ' || props AS message, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN event_id % 3 = 0 THEN 'WARN' ELSE 'INFO' END || ' [t' || user_id || '] ' || event_type || ' ' || props AS raw_line FROM events")
def source_log_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_id") % 3 == 0, " WARN [t").otherwise(" INFO [t")
    return _events(spark, sf_dir, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, F.col("user_id").cast("string"), F.lit("] "), "event_type", F.lit(" "), "props"))
