"""Masks, validators, transforms and patterns on single values."""

import ipaddress
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.errors import InvalidInput
from veilframe.functions import masking, regex, transforms, validators
from veilframe.plans.rules import PRESETS, Rule, RuleStore, Segment, SegmentTemplate, SimpleTemplate, built_in, template_from, template_to

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def over(spark, values, *made):
    """Results of column functions over values, in their order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    rows = df.select("i", *[m(F.col("v")).alias(f"r{k}") for k, m in enumerate(made)]).orderBy("i").collect()
    return [r[1] if len(made) == 1 else tuple(r)[1:] for r in rows]


def template(t, **more):
    return Rule("t", "t", "mask", template=t, **more)


@pytest.mark.parametrize(
    "rule, value, want",
    [
        (None, "13812345678", "1*********8"), (None, "ab", "**"), (None, "a", "*"), (None, "", ""), (None, None, ""), (None, "张三丰四", "张**四"),
        (Rule("n", "n", "mask", replacement="#"), "13812345678", "1#########8"), (Rule("n", "n", "mask"), "ab", "a*"), (Rule("n", "n", "mask"), "a", "*"), (Rule("n", "n", "mask"), "", ""),
        (Rule("v", "v", "validate"), "abc", "a*c"),
        (template(SegmentTemplate("@", (Segment(0, 1, 1, 1),))), "zhangsan@example.com", "z******n@example.com"), (template(SegmentTemplate("@", (Segment(0, 1, 1, 1),))), "user@qq.com", "u**r@qq.com"),
        (template(SegmentTemplate(".", (Segment(2, 0, 0, 2), Segment(9)))), "192.168.11.1", "192.168.**.1"), (template(SegmentTemplate("-", (Segment(1),))), "a--b", "a-*-b"),
        (template(SegmentTemplate("", (Segment(0),))), "abc", "abc"), (template(SimpleTemplate(reverse=True)), "abc", "abc"),
        (template(SimpleTemplate(3, 4, reverse=True)), "13812345678", "***1234****"), (template(SimpleTemplate(2, 2, reverse=True)), "abcdef", "**cd**"), (template(SimpleTemplate(6, 6, reverse=True)), "13812345678", "***********"),
        (template(PRESETS["phone"]), "13812345678", "138****5678"), (template(PRESETS["phone"]), "", "****"), (template(PRESETS["idcard"]), "110101199005151234", "110101********1234"), (template(SimpleTemplate(3, 4), replacement="#"), "13812345678", "138####5678"),
    ],
)
def test_masks(spark, rule, value, want):
    assert over(spark, [value], lambda c: masking.mask(c, rule)) == [want]


def plain_mask(v, kp, ks, least, reverse):
    n, tail = len(v), max(len(v) - ks, 0)
    head = min(kp, n)
    if reverse:
        return "" if not n else "*" * max(n, least) if tail <= head else "*" * kp + v[head:tail] + "*" * ks
    return "*" * least if tail <= head else v[:head] + "*" * max(tail - head, least) + v[tail:]


@few
@given(st.lists(st.text("ab汉🙂é", max_size=14), min_size=1, max_size=20), st.integers(0, 6), st.integers(0, 6), st.integers(0, 5), st.booleans())
def test_masks_against_python(spark, values, kp, ks, least, reverse):
    assert over(spark, values, lambda c: masking.mask(c, template(SimpleTemplate(kp, ks, "*", least, reverse)))) == [plain_mask(v, kp, ks, least, reverse) for v in values]


@pytest.mark.parametrize(
    "params, good, bad",
    [
        ({"validator": "idcard"}, ["11010519491231002X", "11010519491231002x", "110105194912310038"], ["110105194912310021", "12345", "11010519491231002A", "110101199005151234", "44030419920720123X", "", None]),
        ({"validator": "luhn"}, ["6222021234567890128", "00"], ["6222021234567890123", "6225887654321098", "0", "", "62 22"]),
        ({"validator": "ipv4"}, ["192.168.1.1", "0.0.0.0", "255.255.255.255"], ["256.1.1.1", "192.168.1", "192.168.01.1", "1.1.1.1\n"]),
        ({"validator": "ipv6"}, ["::1", "2001:db8::1", "fe80::1", "::", "::ffff:1.2.3.4"], ["::g", "2001:db8:::1", "1:2:3", "fe80::1%eth0"]),
        ({"validator": "phonePrefix"}, ["13412345678", "79912345678"], ["1341234567", "1341234567a", "", None]),
        ({"validator": "phonePrefix", "allowedPrefixes": ["134"]}, ["13412345678"], ["15912345678"]),
        ({"validator": "username"}, ["admin", "91xxev"], ["ab.cd", "ad_1in", "a-123", "", "é"]),
        ({"validator": "sex"}, ["男", " 女　"], ["M", "", "男女"]),
        ({"validator": "birth"}, ["20031223", "2003-12-23", "2003/12/23", "2003.12.23"], ["20031323", "20031200", "2003-12", "", "18991231"]),
        ({"validator": "birth", "formats": ["yyyymmdd"]}, ["20031223"], ["2003-12-23"]),
        ({"validator": "birth", "formats": ["other"]}, [], ["20031223"]),
        ({"validator": "address"}, ["北京市朝阳区建国路88号"], ["张三", "hello world", "北京市A区1号路", "北京天津"]),
        ({"validator": "address", "minHao": 1, "maxHao": 1500, "minShi": 101, "maxShi": 999}, ["北京市朝阳区88号101室", "北京市朝阳区路"], ["北京市1号2栋5189号375室", "北京市朝阳区88号1室"]),
        ({"validator": "email"}, ["user@example.com", "user.name@domain.co", "a@b.c", " a@b.c "], ["@b.com", "a@", "a@b", "a b@c.com", "", "a@@b.c", "a@b..c", "x" * 65 + "@b.c"]),
        ({"validator": "generic", "minLen": 3}, ["abc123"], ["ab", "a#b", ""]),
        ({"validator": "generic", "allowSpecialChars": "@]^-\\"}, ["a@b", "]^-\\"], ["a#b"]),
        ({"validator": "generic", "allowDigits": False, "allowLetters": False}, [], ["a", "1", ""]),
    ],
)
def test_validators(spark, params, good, bad):
    got = over(spark, [*good, *bad], lambda c: validators.validated(c, params)["valid"])
    assert got == [True] * len(good) + [False] * len(bad)


def test_notes(spark):
    assert over(spark, ["11010519491231002X", "110105194912310038", "x"], lambda c: validators.validated(c, {"validator": "idCard"})["note"]) == ["女", "男", "非合法身份证号"]
    assert over(spark, ["x"], lambda c: validators.validated(c, None)["valid"]) == [True]
    with pytest.raises(InvalidInput):
        validators.validated(F.lit("x"), {"validator": "no"})
    assert validators.phone_prefixes([" 134 ", "13", "abc", "１３４"]) == ["134"]


def test_addresses_of_version_6(spark):
    rng = random.Random(1)
    some = ["".join(rng.choice(["1", "ab", ":", "::", "1.2.3.4", "ffff", "0", "fffff", "255.1.1.300"]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]

    def valid(t):
        try:
            ipaddress.IPv6Address(t)
            return "%" not in t
        except ValueError:
            return False

    assert over(spark, some, validators.is_ipv6) == [valid(t) for t in some]


def test_transforms(spark):
    hello = over(spark, ["hello", ""], *[lambda c, a=a: transforms.digest(c, a) for a in ("md5", "sha1", "sha256")])
    assert hello[0] == ("5d41402abc4b2a76b9719d911017c592", "aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824")
    assert hello[1][0] == "d41d8cd98f00b204e9800998ecf8427e"
    long = "é" * 100
    assert over(spark, [long, "hi", None], transforms.base64_encode)[1:] == ["aGk=", None]
    assert over(spark, [long], lambda c: transforms.base64_decode(transforms.base64_encode(c))) == [long]
    assert over(spark, ["aGVsbG8=", "aGVsbG8", "aGVsbG9=", "/w==", "!", ""], transforms.base64_decode) == ["hello", None, None, None, None, ""]
    assert over(spark, ["straße", None], lambda c: transforms.change_case(c, "upper")) == ["STRASSE", None]
    for bad in (lambda: transforms.digest(F.lit(""), "crc"), lambda: transforms.change_case(F.lit(""), "title"), lambda: transforms.replace(F.lit(""), "", "x")):
        with pytest.raises(InvalidInput):
            bad()


def test_patterns(spark):
    assert over(spark, ["电话13812345678", "13812345678"], lambda c: F.size(regex.extract_all(c, r"\b[1-9]\d{10}\b"))) == [0, 1]
    assert over(spark, ["a\n", "a"], lambda c: regex.matches(c, "a$")) == [False, True]
    replaced = lambda p, r: over(spark, ["ab12"], lambda c: regex.replace_all(c, p, r))[0]
    assert replaced(r"([a-z])([a-z])", "$2$1") == "ba12" and replaced(r"(?P<x_y>[a-z]+)", "<${x_y}$$>") == "<ab$>12"
    assert replaced("(a)", "$1x") == "b12" and replaced("(a)", "${1}x") == "axb12" and replaced("(a)", "$9\\") == "\\b12" and replaced("(a)", "${1}0") == "a0b12"
    for bad in ("(?=a)", r"(a)\1", "(", "(?<!a)b"):
        with pytest.raises(InvalidInput):
            regex.checked(bad)


def test_spans(spark):
    spans = lambda made: [[tuple(s) for s in r] for r in made]
    assert spans(over(spark, ["张ab三abab", "", None, "AB"], lambda c: transforms.keyword_spans(c, "ab"))) == [[(3, 5), (8, 10), (10, 12)], [], [], []]
    assert spans(over(spark, ["é1 22x333", "none"], lambda c: transforms.pattern_spans(c, r"\d+"))) == [[(2, 3), (4, 6), (7, 10)], []]
    assert over(spark, ["aXÉ", "axé"], lambda c: transforms.contains_keyword(c, "xÉ")) == [True, False]


@few
@given(st.lists(st.text("a1é\n汉\0", max_size=20), min_size=1, max_size=10), st.sampled_from(["[a1]+", "a*", "1|é*"]))
def test_pattern_spans_against_python(spark, values, pattern):
    want = [[(len(v[: m.start()].encode()), len(v[: m.end()].encode())) for m in re.finditer(pattern, v) if m[0]] for v in values]
    assert [[tuple(s) for s in r] for r in over(spark, values, lambda c: transforms.pattern_spans(c, pattern))] == want


def test_rules(tmp_path):
    assert len(built_in()) == 18 and len({r.id for r in built_in()}) == 18
    store = RuleStore(str(tmp_path / "rules.json"))
    store.toggle("name-mask", False)
    store.update_params("name-extract", pattern="[a-z]+")
    store.update_template("segment-mask", SegmentTemplate("@", (Segment(0, 1, 1, 1),), "#"))
    store.update_extract("phone-extract", params={"validator": "phonePrefix", "allowedPrefixes": ["134"]})
    again = RuleStore(str(tmp_path / "rules.json"))
    assert again.rules == store.rules and not again.get("name-mask").enabled and again.get("name-extract").pattern == "[a-z]+"
    assert [r.name for r in again.list()] == sorted(r.name for r in built_in()) and again.count() == 18
    assert again.update_template("segment-mask").template is None
    assert isinstance(template_from({"delimiter": "@", "segments": [{"index": 0}]}), SegmentTemplate) and template_from({"keepPrefix": 2, "odd": 1}) == SimpleTemplate(2)
    assert template_from(template_to(PRESETS["phone"])) == PRESETS["phone"]
    from veilframe.errors import ProcessorError

    with pytest.raises(ProcessorError):
        store.get("no-such-rule")


def test_many_spans_in_one_cell(spark):
    text = "éab " * 100_000
    want = [(5 * k + 2, 5 * k + 4) for k in range(100_000)]
    for made in (transforms.keyword_spans, transforms.pattern_spans):
        assert [tuple(s) for s in over(spark, [text], lambda c, made=made: made(c, "ab"))[0]] == want


def test_scripts_and_greedy_repetitions(spark):
    assert over(spark, ["汉字x", "xπ", "ab"], lambda c: c.rlike(regex.checked(r"^\p{Han}+x")), lambda c: c.rlike(regex.checked(r"[\p{Greek}]$")), lambda c: c.rlike(regex.checked(r"^\P{Han}\p{L}$"))) == [(True, False, False), (False, True, True), (False, False, True)]
    assert regex.translate(r"\\p{Han}") == r"(?U)\\p{Han}" and regex.translate(r"\p{Alpha}{2}?") == r"(?U)\p{Alpha}{2}?"
    for bad in ("a*+", "a++b", "a?+", "a{2,3}+", "(?>a)b"):
        with pytest.raises(InvalidInput):
            regex.checked(bad)
    for good in ("[*+]+", r"\++", "a+?", r"\p{Han}+", "a{2}", "(a+)+"):
        regex.checked(good)


def test_patterns_that_take_exponential_time_are_refused(spark):
    for bad in (r"(a+)+$", r"(a*)*b", r"(a|aa)+$", r"(\d+\.?)*x", r"([a-z]+)*1", r"(.*,)*x", r"(a|a)*b", r"^(([a-z])+.)+[A-Z]([a-z])+$", r"(x+x+)+y", r"(\w+\s?)*:", r"((ab)*)*c", r"(?P<n>\p{L}+-?)*!"):
        with pytest.raises(InvalidInput, match="exponential"):
            regex.checked(bad)
    good = [r"a.*b.*c", r"(\d{1,3}\.){3}\d{1,3}", r"(\d{4} ?){4}", r"(a|b)*c", r"(\w+,)*\w+", r"(?:[a-z]+ )*end", r"(a?){20}", r'"(?:[^"\\]|\\.)*"', r"\p{Han}+", r"(a|b|ab)c*", r"x{1000}", r"(?P<k>\w+)=(?P<v>[^;]*);", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"]
    for pattern in good + [r.pattern for r in built_in() if r.pattern]:
        regex.checked(pattern)


def test_repetitions_behind_which_a_match_may_end_are_not_refused(spark):
    text = "a" * 400 + "!"
    for pattern in ("(a+)+", "(a*)*", "(a|aa)+", "(a+)+b?", "^(a+)+(bc)?", "(a+)+(x*y)?"):
        assert over(spark, [text], lambda c, p=pattern: F.length(F.get(regex.extract_all(c, p), F.lit(0)))) == [400]
    for bad in (r"(a+)+\b", "((a+)+b)*", "((a+)+c|d)?", "(a+)+b", "(a+)+(b|c)", "(a+)+$|x"):
        with pytest.raises(InvalidInput, match="exponential"):
            regex.checked(bad)
