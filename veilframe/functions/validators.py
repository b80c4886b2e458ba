"""Validators: text column to struct<valid: boolean, note: string>. All built-in expressions; null counts as empty."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.errors import InvalidInput
from veilframe.functions.transforms import let

# Weights and check characters of national ids, address words, notes.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = ("1", "0", "X", "9", "8", "7", "6", "5", "4", "3", "2")
ADDRESS_WORDS = ("省", "市", "区", "县", "镇", "乡", "村", "路", "街", "道", "号", "室", "楼", "单元", "栋", "幢", "弄", "巷", "里", "组", "旗", "盟", "社区", "大厦", "小区", "花园")
NOTES = {
    "phonePrefix": "非合法手机号",
    "phoneDigits": "手机号须为 11 位纯数字",
    "luhn": "未通过 Luhn 校验",
    "ipv4": "非合法 IPv4 地址",
    "ipv6": "非合法 IPv6 地址",
    "idcard": "非合法身份证号",
    "username": "用户名须为纯字母数字",
    "sex": "性别须为「男」或「女」",
    "birth": "出生日期格式不符（清理后须为 8 位有效日期）",
    "birthFormat": "出生日期格式不符（须为勾选的格式之一）",
    "address": "地址格式不符（须全中文+地址关键词+号/室范围）",
    "email": "邮箱格式不符",
    "generic": "通用校验未通过（字符类或长度不符）",
}
BIRTH_FORMATS = {"yyyymmdd": "[0-9]{8}", "yyyy-mm-dd": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy/mm/dd": "[0-9]{4}/[0-9]{2}/[0-9]{2}", "yyyy.mm.dd": r"[0-9]{4}\.[0-9]{2}\.[0-9]{2}"}

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6() -> str:
    h = "[0-9a-fA-F]{1,4}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{_IPV4}"]
    for left in range(8):  # groups before the ::
        head = f"{h}(?::{h}){{{left - 1}}}" if left else ""
        most = 7 - left
        forms.append(f"{head}::" + (f"(?:{h}(?::{h}){{0,{most - 1}}})?" if most else ""))
        if most >= 2:
            forms.append(f"{head}::(?:{h}:){{0,{most - 2}}}{_IPV4}")
    return r"\A(?:" + "|".join(forms) + r")\z"


IPV6 = _ipv6()


#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def is_phone(text: Column, prefixes: Iterable[str] = ()) -> Column:
    prefixes = list(prefixes)
    digits = text.rlike(r"\A[0-9]{11}\z")
    return digits & reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes]) if prefixes else digits


def is_luhn(text: Column) -> Column:
    """Two or more ASCII digits whose Luhn sum is a multiple of 10."""
    return text.rlike(r"\A[0-9]{2,}\z") & F.call_function("luhn_check", text)


def is_ipv4(text: Column) -> Column:
    return text.rlike(rf"\A{_IPV4}\z")


def is_ipv6(text: Column) -> Column:
    return text.rlike(IPV6)


def idcard_check(text: Column) -> Column:
    """The check character of a text that begins with 17 digits. They are one number, named once: plans stay small whatever the text is made of."""

    def check(number: Column) -> Column:
        weighted = [F.call_function("div", number, F.lit(10 ** (16 - i))) % 10 * w for i, w in enumerate(ID_WEIGHTS)]
        return F.element_at(F.array(*map(F.lit, ID_CHECKS)), (reduce(lambda a, b: a + b, weighted) % 11 + 1).cast("int"))

    return let(F.substring(text, 1, 17).try_cast("bigint"), check)


def is_idcard(text: Column) -> Column:
    """18 characters, the last one the check character of the weighted sum; x counts as X. Date and region aren't looked at."""
    return F.when(text.rlike(r"\A[0-9]{17}[0-9Xx]\z"), F.upper(F.substr(text, F.lit(18), F.lit(1))) == idcard_check(text)).otherwise(False)


def idcard_gender(text: Column) -> Column:
    return F.when((F.ascii(F.substr(text, F.lit(17), F.lit(1))) - 48) % 2 == 1, "男").otherwise("女")


def is_username(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z0-9]+\z")


def is_sex(text: Column) -> Column:
    return trim(text).isin("男", "女")


def clean_birth(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def is_birth(text: Column, formats: Iterable[str] = ()) -> Column:
    """Eight digits once all else is gone: year 1900-2100, month 1-12, day 1-31. With formats the text has one of them too."""
    valid = clean_birth(text).rlike(r"\A(?:19[0-9]{2}|20[0-9]{2}|2100)(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])\z")
    formats = list(formats)
    if not formats:
        return valid
    known = [BIRTH_FORMATS[f] for f in formats if f in BIRTH_FORMATS]
    return text.rlike(r"\A(?:" + "|".join(known) + r")\z") & valid if known else F.lit(False)


def is_address(text: Column, min_hao: int | None = None, max_hao: int | None = None, min_shi: int | None = None, max_shi: int | None = None) -> Column:
    """4 to 200 characters, no ASCII letter, two CJK characters, an address word; the numbers before the last 号 and 室 in range."""
    value = trim(text)
    n = F.char_length(value)
    valid = n.between(4, 200) & ~value.rlike("[A-Za-z]") & value.rlike(r"[一-龥][^一-龥]*[一-龥]") & value.rlike("|".join(ADDRESS_WORDS))

    def in_range(word: str, low: int | None, high: int | None) -> Column:
        found = F.regexp_extract(value, rf"([0-9]+){word}[^{word}]*\z", 1)
        number = found.try_cast("bigint")
        usable = (found != "") & number.isNotNull() & (number < 2**32)
        bounds = F.lit(True)
        if low is not None:
            bounds = bounds & (number >= low)
        if high is not None:
            bounds = bounds & (number <= high)
        return F.when(usable, bounds).otherwise(True)

    if min_hao is not None or max_hao is not None:
        valid = valid & in_range("号", min_hao, max_hao)
    if min_shi is not None or max_shi is not None:
        valid = valid & in_range("室", min_shi, max_shi)
    return valid


def is_email(text: Column) -> Column:
    value = trim(text)
    return (F.octet_length(value) <= 254) & value.rlike(r"\A[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\z")


def is_generic(text: Column, digits: bool = True, letters: bool = True, specials: str = "", min_len: int | None = None, max_len: int | None = None) -> Column:
    """Only characters of the allowed classes, at least one, and a length in range. With all classes off nothing is valid."""
    allowed = "0-9" * digits + "A-Za-z" * letters + "".join(f"\\x{{{ord(c):x}}}" for c in specials)
    if not allowed:
        return F.lit(False)
    n = F.char_length(text)
    valid = text.rlike(rf"\A[{allowed}]+\z")
    valid = valid & (n >= min_len) if min_len is not None else valid
    return valid & (n <= max_len) if max_len is not None else valid


def validity(text: Column, params: dict[str, Any] | None) -> tuple[Column, str, Column]:
    """For params {"validator": tag, ...}: whether the text is valid, the note where it isn't, and the note where it is. Without params everything is valid."""
    value, nothing = F.coalesce(text, F.lit("")), F.lit("")
    tag = (params or {}).get("validator")
    p = params or {}
    if params is None:
        return F.lit(True), "", nothing
    if tag == "phonePrefix":
        return is_phone(value, p.get("allowedPrefixes", p.get("allowed_prefixes")) or ()), NOTES["phonePrefix"], nothing
    if tag in ("idcard", "idCard"):
        return is_idcard(value), NOTES["idcard"], idcard_gender(value)
    if tag == "birth":
        formats = p.get("formats") or ()
        return is_birth(value, formats), NOTES["birthFormat" if formats else "birth"], nothing
    if tag == "address":
        return is_address(value, p.get("minHao"), p.get("maxHao"), p.get("minShi"), p.get("maxShi")), NOTES["address"], nothing
    if tag == "generic":
        return is_generic(value, p.get("allowDigits", True), p.get("allowLetters", True), p.get("allowSpecialChars") or "", p.get("minLen"), p.get("maxLen")), NOTES["generic"], nothing
    plain = {"luhn": is_luhn, "ipv4": is_ipv4, "ipv6": is_ipv6, "username": is_username, "sex": is_sex, "email": is_email}
    if tag not in plain:
        raise InvalidInput(f"unknown validator {tag!r}")
    return plain[tag](value), NOTES[tag], nothing


def validated(text: Column, params: dict[str, Any] | None) -> Column:
    """struct<valid, note> for params {"validator": tag, ...}; without params everything is valid."""
    valid, bad, good = validity(text, params)
    return F.struct(valid.alias("valid"), F.when(valid, good).otherwise(F.lit(bad)).alias("note"))


def normal_gender(text: Column) -> Column:
    """男, 女, or null if the text says neither."""
    return let(F.lower(trim(text)), lambda value: F.when(value.isin("男", "male", "m", "1"), "男").when(value.isin("女", "female", "f", "2"), "女"))


def gender_mismatch(inferred: Column, raw: Column) -> Column:
    """A message if both genders are known and differ, else null."""
    both = F.struct(inferred.alias("inferred"), raw.alias("raw"), normal_gender(inferred).alias("a"), normal_gender(raw).alias("b"))
    return let(both, lambda g: F.when(g["a"] != g["b"], F.concat(F.lit("性别不一致: 身份证推断"), g["inferred"], F.lit("，性别列"), g["raw"])))


def phone_prefixes(given: Iterable[str]) -> list[str]:
    """The entries that are three digits once trimmed."""
    return [p.strip() for p in given if len(p.strip()) == 3 and p.strip().isascii() and p.strip().isdigit()]
