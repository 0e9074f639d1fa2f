"""YAML settings to dataclasses: defaults, decoding, and validation that reports every error."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

LEAVES = ("probabilistic", "remote_probabilistic", "span_count", "latency", "status_code", "ottl_condition", "threshold")
COMPOSITES = ("and", "root_spans", "downgrader")
#: Constructs that Spark's regular expressions have and the rules may not use.
_NOT_PORTABLE = re.compile(r"\(\?[=!<]|\\[1-9]|\(\?>|[*+?}]\+")


class ConfigError(ValueError):
    """All that is wrong with a configuration."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Mapping_:
    pattern: str
    value: str


@dataclass(frozen=True)
class RecordDecisionFrom:
    res_attr_key: str = ""
    mappings: tuple[Mapping_, ...] = ()


@dataclass(frozen=True)
class PolicyConfig:
    """One policy.  ``options`` holds the keys of the block named like its type; sub-policies are in ``subs``."""

    name: str = ""
    type: str = ""
    emit_single_span_for_not_sampled: bool = False
    options: Mapping[str, Any] = field(default_factory=dict)
    subs: tuple[PolicyConfig, ...] = ()
    record_decision_from: RecordDecisionFrom | None = None


@dataclass(frozen=True)
class Config:
    shards: int = 1
    policies: tuple[PolicyConfig, ...] = ()
    target_heap_bytes: int = 0
    regulate_cache_delay_s: float = 0.0
    primary_cache_size: int = 1000
    secondary_cache_size: int = 100
    sampled_cache_size: int = 10000
    non_sampled_cache_size: int = 10000
    flush_on_shutdown: bool = False
    compression_enabled: bool = False
    preprocess_buffer_size: int = 0

    @property
    def initial_primary_size(self) -> int:
        """What the primary cache holds until a regulator resizes it: 60 % of its size."""
        return int(0.6 * self.primary_cache_size)

    def errors(self) -> list[str]:
        out = []
        if self.primary_cache_size <= 0:
            out.append("primary_cache_size must be greater than 0")
        if self.secondary_cache_size <= 0 or self.secondary_cache_size > self.primary_cache_size // 2:
            out.append("secondary_cache_size must be greater than 0 and at most half of primary_cache_size")
        if self.preprocess_buffer_size < 0:
            out.append("preprocess_buffer_size must be at least 0")
        if self.shards <= 0:
            out.append("shards must be greater than 0")
        names = [p.name for p in self.policies]
        if len(set(names)) < len(names):
            out.append("policy names must be unique")
        for p in self.policies:
            rule = p.record_decision_from
            if rule is None:
                continue
            if not rule.res_attr_key:
                out.append(f"policy {p.name!r}: record_decision_from needs res_attr_key")
            for i, m in enumerate(rule.mappings):
                if not m.pattern:
                    out.append(f"policy {p.name!r}: mapping {i} has no pattern")
                    continue
                try:
                    re.compile(m.pattern)
                    if _NOT_PORTABLE.search(m.pattern):
                        out.append(f"policy {p.name!r}: mapping {i}: {m.pattern!r} isn't a portable regular expression")
                except re.error as e:
                    out.append(f"policy {p.name!r}: mapping {i}: {m.pattern!r} isn't a regular expression: {e}")
        return out

    def validate(self) -> Config:
        if errors := self.errors():
            raise ConfigError(errors)
        return self


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration(value: Any) -> float:
    """Seconds of a duration such as ``1h30m`` or ``250ms``; a bare 0 is allowed."""
    text = str(value).strip()
    if text in ("", "0"):
        return 0.0
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", text)
    if "".join(a + b for a, b in parts) != text.lstrip("+-"):
        raise ConfigError([f"not a duration: {text!r}"])
    return (-1 if text[0] == "-" else 1) * sum(float(n) * _UNITS[u] for n, u in parts)


def _policy(raw: Mapping[str, Any]) -> PolicyConfig:
    kind = raw.get("type", "")
    block = raw.get(kind) or {}
    subs: tuple[PolicyConfig, ...] = ()
    if kind == "and":
        subs = tuple(_policy(s) for s in block.get("and_sub_policy") or ())
    elif kind in COMPOSITES:
        subs = (_policy(block.get("sub_policy") or {}),)
    record = raw.get("record_decision_from")
    rule = None
    if record is not None:
        rule = RecordDecisionFrom(record.get("res_attr_key", ""), tuple(Mapping_(m.get("pattern", ""), m.get("value", "")) for m in record.get("mappings") or ()))
    options = {k: v for k, v in block.items() if k not in ("and_sub_policy", "sub_policy")}
    return PolicyConfig(raw.get("name", ""), kind, bool(raw.get("emit_single_span_for_not_sampled", False)), options, subs, rule)


_PLAIN = ("shards", "target_heap_bytes", "primary_cache_size", "secondary_cache_size", "flush_on_shutdown", "compression_enabled", "preprocess_buffer_size")


def from_dict(raw: Mapping[str, Any] | None) -> Config:
    """Settings from decoded YAML; keys that are not given keep their defaults, unknown keys are errors."""
    raw = dict(raw or {})
    known = {*_PLAIN, "policies", "regulate_cache_delay", "decision_cache"}
    if unknown := sorted(set(raw) - known):
        raise ConfigError([f"unknown key {k!r}" for k in unknown])
    values: dict[str, Any] = {k: raw[k] for k in _PLAIN if k in raw}
    if "regulate_cache_delay" in raw:
        values["regulate_cache_delay_s"] = duration(raw["regulate_cache_delay"])
    for k, v in (raw.get("decision_cache") or {}).items():
        values[k] = v
    values["policies"] = tuple(_policy(p) for p in raw.get("policies") or ())
    return Config(**values)


def load(text: str, section: str | None = None) -> Config:
    """Settings from YAML text.  With ``section``, those below that key; else the document, or its only key's value if that is a map of settings."""
    import yaml

    raw = yaml.safe_load(text) or {}
    if section is not None:
        raw = raw.get(section) or {}
    elif len(raw) == 1 and isinstance(only := next(iter(raw.values())), dict) and next(iter(raw)) not in {*_PLAIN, "policies", "decision_cache"}:
        raw = only
    return from_dict(raw)
