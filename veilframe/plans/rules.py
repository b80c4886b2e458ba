"""Rules for masking, validating and extracting, their JSON form, and the store of a workbench."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

from veilframe.errors import InvalidInput, ProcessorError

KINDS = ("mask", "validate", "extract")


@dataclass(frozen=True)
class SimpleTemplate:
    """Ends kept (or, reversed, hidden) and the least number of mask characters."""

    keep_prefix: int | None = None
    keep_suffix: int | None = None
    mask_char: str | None = None
    mask_min_len: int | None = None
    reverse: bool | None = None

    def is_empty(self) -> bool:
        return self.keep_prefix is None and self.keep_suffix is None and self.mask_char is None and self.mask_min_len is None


@dataclass(frozen=True)
class Segment:
    index: int
    keep_prefix: int | None = None
    keep_suffix: int | None = None
    mask_min_len: int | None = None


@dataclass(frozen=True)
class SegmentTemplate:
    """Masks for the parts between delimiters."""

    delimiter: str
    segments: tuple[Segment, ...] = ()
    mask_char: str | None = None

    def is_empty(self) -> bool:
        return not self.delimiter or not self.segments


#: Kept prefix, kept suffix and least mask length of common values.
PRESETS = {
    "idcard": SimpleTemplate(6, 4, "*", 8),
    "phone": SimpleTemplate(3, 4, "*", 4),
    "birthdate": SimpleTemplate(8, 0, "*", 2),
    "bankcard": SimpleTemplate(4, 4, "*", 1),
}

_SIMPLE = {"keepPrefix": "keep_prefix", "keepSuffix": "keep_suffix", "maskChar": "mask_char", "maskMinLen": "mask_min_len", "reverse": "reverse"}


def template_from(data: dict[str, Any] | None) -> SimpleTemplate | SegmentTemplate | None:
    """A template from its JSON form: by segment if it has a delimiter, else simple. Unknown keys don't count."""
    if data is None:
        return None
    if "delimiter" in data and "segments" in data:
        segments = tuple(Segment(s["index"], *(s.get(k) for k in ("keepPrefix", "keepSuffix", "maskMinLen"))) for s in data["segments"])
        return SegmentTemplate(data["delimiter"], segments, data.get("maskChar"))
    return SimpleTemplate(**{name: data[key] for key, name in _SIMPLE.items() if data.get(key) is not None})


def template_to(template: SimpleTemplate | SegmentTemplate) -> dict[str, Any]:
    if isinstance(template, SegmentTemplate):
        parts = [{"index": s.index, "keepPrefix": s.keep_prefix, "keepSuffix": s.keep_suffix, "maskMinLen": s.mask_min_len} for s in template.segments]
        return {"maskChar": template.mask_char, "delimiter": template.delimiter, "segments": parts}
    return {key: getattr(template, name) for key, name in _SIMPLE.items() if getattr(template, name) is not None}


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    kind: str
    field: str | None = None
    pattern: str | None = None
    replacement: str | None = None
    enabled: bool = True
    description: str = ""
    template: SimpleTemplate | SegmentTemplate | None = None
    params: dict[str, Any] | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise InvalidInput(f"unknown kind of rule {self.kind!r}")

    def to_json(self) -> dict[str, Any]:
        out = {k: getattr(self, k) for k in ("id", "name", "kind", "field", "pattern", "replacement", "enabled", "description")}
        if self.template is not None:
            out["template"] = template_to(self.template)
        if self.params is not None:
            out["params"] = self.params
        return out

    @staticmethod
    def from_json(data: dict[str, Any]) -> Rule:
        plain = {k: data[k] for k in ("id", "name", "kind", "field", "pattern", "replacement", "enabled", "description") if k in data}
        return Rule(**plain, template=template_from(data.get("template")), params=data.get("params"))


def _rule(kind: str, rule_id: str, name: str, pattern: str | None = None, validator: str | None = None, **more: Any) -> Rule:
    return Rule(rule_id, name, kind, pattern=pattern, params={"validator": validator} if validator else None, **more)


def built_in() -> list[Rule]:
    """The rules that every store starts with. Ids, names and patterns are fixed values."""
    return [
        _rule("validate", "name-validate", "姓名校验", "^[一-龥]{2,4}$"),
        _rule("mask", "name-mask", "姓名脱敏"),
        _rule("extract", "name-extract", "姓名提取", "[一-龥]{2,4}"),
        _rule("mask", "simple-mask", "整段脱敏", template=SimpleTemplate()),
        _rule("mask", "segment-mask", "分段脱敏", template=SegmentTemplate("")),
        _rule("extract", "phone-extract", "手机号提取", r"\b[1-9]\d{10}\b", "phonePrefix"),
        _rule("extract", "bankcard-extract", "银行卡号提取", r"\b[1-9]\d{12,18}\b", "luhn"),
        _rule("extract", "ip4-extract", "IPv4地址提取", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "ipv4"),
        _rule("extract", "ip6-extract", "IPv6地址提取", "(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}", "ipv6"),
        _rule("extract", "idcard-extract", "身份证号提取", r"\b[1-9]\d{16}[\dXx]\b", "idcard"),
        _rule("validate", "username-validate", "用户名校验", validator="username"),
        _rule("validate", "sex-validate", "性别校验", validator="sex"),
        _rule("validate", "birth-validate", "出生日期校验", validator="birth"),
        _rule("validate", "idcard-validate", "身份证号校验", validator="idcard"),
        _rule("validate", "phone-validate", "手机号校验", validator="phonePrefix"),
        _rule("validate", "address-validate", "地址校验", validator="address"),
        _rule("validate", "generic-validate", "通用校验", validator="generic"),
        _rule("validate", "email-validate", "邮箱校验", validator="email"),
    ]


#: The pattern of id cards where a leading zero is allowed.
IDCARD_ANY_FIRST_DIGIT = r"\b\d{17}[\dXx]\b"


class RuleStore:
    """Rules by id, kept in a JSON file where a path is given."""

    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else None
        self.rules = {r.id: r for r in built_in()}
        if self.path and self.path.exists():
            self.rules |= {r["id"]: Rule.from_json(r) for r in json.loads(self.path.read_text("utf-8"))}

    def _save(self) -> None:
        if self.path:
            self.path.write_text(json.dumps([r.to_json() for r in self.list()], ensure_ascii=False, indent=1), "utf-8")

    def list(self) -> list[Rule]:
        return sorted(self.rules.values(), key=lambda r: r.name)

    def find(self, rule_id: str | None) -> Rule | None:
        return self.rules.get(rule_id) if rule_id else None

    def get(self, rule_id: str) -> Rule:
        if rule_id not in self.rules:
            raise ProcessorError(f"规则 `{rule_id}` 不存在")
        return self.rules[rule_id]

    def count(self) -> int:
        return len(self.rules)

    def register(self, rule: Rule) -> None:
        self.rules[rule.id] = rule
        self._save()

    def _change(self, rule_id: str, **new: Any) -> Rule:
        self.register(replace(self.get(rule_id), **new))
        return self.rules[rule_id]

    def toggle(self, rule_id: str, enabled: bool) -> Rule:
        """Marks a rule; operators run a rule whatever its mark, as callers name it."""
        return self._change(rule_id, enabled=enabled)

    def update_params(self, rule_id: str, pattern: str | None = None, replacement: str | None = None) -> Rule:
        """None leaves a value as it is."""
        new = {k: v for k, v in (("pattern", pattern), ("replacement", replacement)) if v is not None}
        return self._change(rule_id, **new)

    def update_template(self, rule_id: str, template: SimpleTemplate | SegmentTemplate | None = None) -> Rule:
        """None removes the template."""
        return self._change(rule_id, template=template)

    def update_extract(self, rule_id: str, pattern: str | None = None, params: dict[str, Any] | None = None) -> Rule:
        """None leaves a value as it is."""
        new = {k: v for k, v in (("pattern", pattern), ("params", params)) if v is not None}
        return self._change(rule_id, **new)
