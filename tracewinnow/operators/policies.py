"""Sampling policies.

A policy has two forms with one meaning: Spark columns, used by batch plans,
and a Python evaluation of one unit, used where state is sequential.

The unit of evaluation is what one batch holds of a trace under one resource.
``aggregates`` are computed over the unit's spans; ``decision`` reads them, and
the trace's running totals ``cum_spans``, ``cum_start`` and ``cum_end``.
Decisions are the names of :class:`tracewinnow.model.Decision`.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config, ConfigError, PolicyConfig
from ..functions import conditions, ids
from ..model import NO_PARENT, THRESHOLD, Decision

log = logging.getLogger(__name__)

SAMPLED, PENDING, LOW, UNSPECIFIED = "Sampled", "Pending", "LowPriority", "Unspecified"


@dataclass
class Unit:
    """A unit's spans, in order, and its trace's totals up to it; for Python evaluation."""

    trace_id: str
    spans: list[dict]
    span_count: int
    earliest_start: int
    latest_end: int
    last_low: str | None = None
    low_priority: bool = False


class Policy:
    """What every policy offers; also the point of extension for new ones."""

    def aggregates(self, key: str) -> dict[str, Column]:
        """Aggregates over a unit's spans, by column names that start with ``key``."""
        return {}

    def salts(self) -> set[str]:
        """Salts of the trace-id hashes that ``decision`` reads."""
        return set()

    def decision(self, key: str) -> Column:
        raise NotImplementedError

    def failed(self, key: str) -> Column:
        """Whether the evaluation reports an error beside its decision."""
        return F.lit(False)

    def evaluate(self, unit: Unit) -> tuple[str, bool]:
        """Decision and whether there was an error."""
        raise NotImplementedError

    def start(self, getters: Mapping[str, Any]) -> None:
        """Called for policies of the list itself, not for those inside others."""


def service_names(spans: list[dict]) -> list[str]:
    """Distinct service names, sorted; resources without one are skipped."""
    found = {((s["resource_attrs"] or {}).get("service.name") or {}).get("s") for s in spans}
    return sorted(x for x in found if x is not None)


def when_sampled(condition: Column) -> Column:
    return F.when(condition, F.lit(SAMPLED)).otherwise(F.lit(PENDING))


@dataclass
class Static(Policy):
    """Always the same decision; for tests."""

    value: str
    error: bool = False

    def decision(self, key):
        return F.lit(self.value)

    def failed(self, key):
        return F.lit(self.error)

    def evaluate(self, unit):
        return self.value, self.error


@dataclass
class Probabilistic(Policy):
    salt: str = ""
    percentage: float = 0.0

    def decision(self, key):
        return when_sampled(ids.at_most(F.col(ids.hash_column(self.salt)), ids.sampling_threshold(self.percentage)))

    def salts(self):
        return {self.salt}

    def evaluate(self, unit):
        h = ids.hash64(self.salt, unit.trace_id)
        return (SAMPLED if h <= ids.sampling_threshold(self.percentage) else PENDING), False


@dataclass
class RemoteProbabilistic(Policy):
    """A percentage that a getter returns; the default, with an error, if it raises or returns a negative number.

    In a plan the getter is asked once, when the decision column is built.
    """

    salt: str = ""
    default: float = 0.0
    getter_name: str = ""
    getter: Callable[[], float] | None = None

    def start(self, getters):
        if not self.getter_name:
            return
        if self.getter_name not in getters:
            raise ConfigError([f"rate getter {self.getter_name!r} could not be found"])
        if not callable(getters[self.getter_name]):
            raise ConfigError([f"{self.getter_name!r} is not a rate getter"])
        self.getter = getters[self.getter_name]

    def rate(self) -> tuple[float, bool]:
        if self.getter is None:
            return self.default, False
        try:
            rate = float(self.getter())
        except Exception:  # noqa: BLE001 - whatever a getter raises means the default rate
            return self.default, True
        return (self.default, True) if rate < 0 else (rate, False)

    def salts(self):
        return {self.salt}

    def decision(self, key):
        return Probabilistic(self.salt, self.rate()[0]).decision(key)

    def failed(self, key):
        return F.lit(self.rate()[1])

    def evaluate(self, unit):
        rate, error = self.rate()
        return Probabilistic(self.salt, rate).evaluate(unit)[0], error


@dataclass
class SpanCount(Policy):
    min_spans: int = 0
    log_sampled: bool = False

    def decision(self, key):
        return when_sampled(F.col("cum_spans") >= self.min_spans)

    def evaluate(self, unit):
        if unit.span_count < self.min_spans:
            return PENDING, False
        if self.log_sampled:
            log.info("trace sampled by span count: trace %s, %d spans, services %s", unit.trace_id, unit.span_count, service_names(unit.spans))
        return SAMPLED, False


@dataclass
class Latency(Policy):
    threshold_ms: int = 0

    def decision(self, key):
        return when_sampled(ids.duration_ms(F.col("cum_start"), F.col("cum_end")) >= self.threshold_ms)

    def evaluate(self, unit):
        gap = unit.latest_end - unit.earliest_start
        return (SAMPLED if (abs(gap) // 1_000_000) * (1 if gap >= 0 else -1) >= self.threshold_ms else PENDING), False


STATUSES = ("OK", "ERROR", "UNSET")


@dataclass
class StatusCode(Policy):
    codes: tuple[str, ...]

    def __post_init__(self):
        if not self.codes:
            raise ConfigError(["expected at least one status code"])
        for c in self.codes:
            if c not in STATUSES:
                raise ConfigError([f'unknown status code "{c}", supported: OK, ERROR, UNSET'])

    def aggregates(self, key):
        return {f"{key}hit": F.bool_or(F.col("status").isin(*self.codes))}

    def decision(self, key):
        return when_sampled(F.coalesce(F.col(f"{key}hit"), F.lit(False)))

    def evaluate(self, unit):
        return (SAMPLED if any(s["status"] in self.codes for s in unit.spans) else PENDING), False


ERROR_MODES = ("ignore", "propagate", "silent", "")


@dataclass
class Condition(Policy):
    """Any span, or any event of a span, for which one of the conditions holds."""

    span: tuple[str, ...] = ()
    event: tuple[str, ...] = ()
    error_mode: str = "ignore"
    parsed: tuple[list, list] = field(init=False)

    def __post_init__(self):
        if not self.span and not self.event:
            raise ConfigError(["expected at least one condition"])
        if self.error_mode not in ERROR_MODES:
            raise ConfigError([f"unknown error mode {self.error_mode!r}"])
        self.parsed = ([conditions.parse(c, "span") for c in self.span], [conditions.parse(c, "event") for c in self.event])

    def aggregates(self, key):
        own, events = self.parsed
        hit = conditions.to_column(own)
        if events:
            hit = hit | F.coalesce(F.exists("events", lambda e: conditions.to_column(events, e)), F.lit(False))
        return {f"{key}hit": F.bool_or(hit)}

    def decision(self, key):
        return when_sampled(F.coalesce(F.col(f"{key}hit"), F.lit(False)))

    def evaluate(self, unit):
        own, events = self.parsed
        hit = any(conditions.holds(c, s) for s in unit.spans for c in own) or any(conditions.holds(c, s, e) for s in unit.spans for e in s["events"] or () for c in events)
        return (SAMPLED if hit else PENDING), False


@dataclass
class Threshold(Policy):
    """The least valid threshold of the unit's spans, compared to the random part of the trace id."""

    def aggregates(self, key):
        return {f"{key}least": F.min(ids.parse_threshold(F.try_element_at("attrs", F.lit(THRESHOLD))["s"]))}

    def decision(self, key):
        least = F.col(f"{key}least")
        return when_sampled(F.coalesce((least < ids.MAX_RV) & (ids.rv(F.col("trace_id")) >= least), F.lit(False)))

    def evaluate(self, unit):
        found = [ids.threshold_value(((s["attrs"] or {}).get(THRESHOLD) or {}).get("s")) for s in unit.spans]
        least = min((t for t in found if t is not None), default=ids.MAX_RV)
        return (SAMPLED if least < ids.MAX_RV and int(unit.trace_id[18:32], 16) >= least else PENDING), False


@dataclass
class And(Policy):
    """The first decision of its policies that isn't Sampled, else Sampled."""

    subs: tuple[Policy, ...]

    def salts(self):
        return {x for s in self.subs for x in s.salts()}

    def aggregates(self, key):
        return {n: c for i, s in enumerate(self.subs) for n, c in s.aggregates(f"{key}{i}_").items()}

    def decision(self, key):
        out = F.lit(SAMPLED)
        for i, s in reversed(list(enumerate(self.subs))):
            d = s.decision(f"{key}{i}_")
            out = F.when(s.failed(f"{key}{i}_"), F.lit(UNSPECIFIED)).when(d != SAMPLED, d).otherwise(out)
        return out

    def failed(self, key):
        out = F.lit(False)
        for i, s in reversed(list(enumerate(self.subs))):
            out = F.when(s.failed(f"{key}{i}_"), F.lit(True)).when(s.decision(f"{key}{i}_") != SAMPLED, F.lit(False)).otherwise(out)
        return out

    def evaluate(self, unit):
        for s in self.subs:
            d, error = s.evaluate(unit)
            if error:
                return UNSPECIFIED, True
            if d != SAMPLED:
                return d, False
        return SAMPLED, False


def root_python(span: dict) -> bool:
    parent = span["parent_span_id"] or NO_PARENT
    return parent in (NO_PARENT, span["trace_id"][16:32])


@dataclass
class RootSpans(Policy):
    """Low priority for a trace of which only a lone root span is known, unless its policy samples that.

    The running total's priority can't be low when policies run (merging keeps
    the higher one, and new data isn't low), so other units are Pending.
    """

    sub: Policy

    def salts(self):
        return self.sub.salts()

    def aggregates(self, key):
        # read only where the trace has one span, which then is the unit's first
        root = F.bool_or(ids.is_root(F.col("trace_id"), F.col("parent_span_id")))
        return {f"{key}root": root, **self.sub.aggregates(f"{key}0_")}

    def decision(self, key):
        failed, sub = self.sub.failed(f"{key}0_"), self.sub.decision(f"{key}0_")
        lone = F.col("cum_spans") == 1
        return F.when(failed | (lone & F.col(f"{key}root").isNull() & (sub != SAMPLED)), F.lit(UNSPECIFIED)).when((sub != SAMPLED) & lone & F.col(f"{key}root"), F.lit(LOW)).otherwise(F.lit(PENDING))

    def failed(self, key):
        return self.sub.failed(f"{key}0_") | ((F.col("cum_spans") == 1) & F.col(f"{key}root").isNull() & (self.sub.decision(f"{key}0_") != SAMPLED))

    def evaluate(self, unit):
        d, error = self.sub.evaluate(unit)
        if error:
            return UNSPECIFIED, True
        if d == SAMPLED:
            return PENDING, False
        default = LOW if unit.low_priority else PENDING
        if unit.span_count != 1:
            return default, False
        if not unit.spans:
            return UNSPECIFIED, True
        return (LOW if root_python(unit.spans[0]) else default), False


@dataclass
class Downgrader(Policy):
    """Another decision where its policy samples."""

    to: str
    sub: Policy

    def __post_init__(self):
        Decision.parse(self.to)

    def salts(self):
        return self.sub.salts()

    def aggregates(self, key):
        return self.sub.aggregates(f"{key}0_")

    def decision(self, key):
        d = self.sub.decision(f"{key}0_")
        return F.when(self.sub.failed(f"{key}0_"), F.lit(UNSPECIFIED)).when(d == SAMPLED, F.lit(self.to)).otherwise(d)

    def failed(self, key):
        return self.sub.failed(f"{key}0_")

    def evaluate(self, unit):
        d, error = self.sub.evaluate(unit)
        return (UNSPECIFIED, True) if error else (self.to if d == SAMPLED else d, False)


@dataclass
class Named:
    """A policy of the list, with what the list knows about it."""

    name: str
    policy: Policy
    emit_placeholder: bool = False
    record_from: str = ""
    mappings: tuple[tuple[str, str], ...] = ()

    def group(self, value: str) -> str:
        """The first mapping whose pattern is found in the value gives its group."""
        return next((v for p, v in self.mappings if re.search(p, value)), value)


def leaf(cfg: PolicyConfig) -> Policy:
    o = cfg.options
    match cfg.type:
        case "probabilistic":
            return Probabilistic(o.get("hash_salt", ""), float(o.get("sampling_percentage", 0)))
        case "remote_probabilistic":
            return RemoteProbabilistic(o.get("hash_salt", ""), float(o.get("default_rate", 0)), str(o.get("rate_getter", "") or ""))
        case "span_count":
            return SpanCount(int(o.get("min_spans", 0)), bool(o.get("log_sampled", False)))
        case "latency":
            return Latency(int(o.get("threshold_ms", 0)))
        case "status_code":
            return StatusCode(tuple(o.get("status_codes") or ()))
        case "ottl_condition":
            return Condition(tuple(o.get("span") or ()), tuple(o.get("spanevent") or ()), o.get("error_mode", "") or "")
        case "threshold":
            return Threshold()
    raise ConfigError([f"unknown sampling policy type {cfg.type}"])


def build(cfg: PolicyConfig) -> Policy:
    """A policy from its settings; policies inside others are leaves."""
    match cfg.type:
        case "and":
            return And(tuple(leaf(s) for s in cfg.subs))
        case "root_spans":
            return RootSpans(leaf(cfg.subs[0]))
        case "downgrader":
            return Downgrader(str(cfg.options.get("downgrade_to", "")), leaf(cfg.subs[0]))
    return leaf(cfg)


def policies(config: Config, getters: Mapping[str, Any] | None = None) -> list[Named]:
    """The policy list of a configuration; rate getters are handed to policies of the list itself."""
    out = []
    for cfg in config.policies:
        if any(n.name == cfg.name for n in out):
            raise ConfigError([f"duplicate policy name {cfg.name!r}"])
        policy = build(cfg)
        if getters is not None:
            policy.start(getters)
        rule = cfg.record_decision_from
        for m in rule.mappings if rule else ():
            try:
                re.compile(m.pattern)
            except re.error as e:
                raise ConfigError([f"policy {cfg.name!r}: {m.pattern!r} isn't a regular expression: {e}"]) from None
        out.append(Named(cfg.name, policy, cfg.emit_single_span_for_not_sampled, rule.res_attr_key if rule else "", tuple((m.pattern, m.value) for m in rule.mappings) if rule else ()))
    return out
