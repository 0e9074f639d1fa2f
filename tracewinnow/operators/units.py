"""Spans to evaluation units: what one batch holds of a trace under one resource."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DECISION
from .policies import Named

UNIT = ("batch_seq", "rs_idx", "trace_id")


def as_text(value: Column) -> Column:
    """An attribute value as text; a missing one is null."""
    return F.coalesce(value["s"], value["b"].cast("string"), value["i"].cast("string"), value["d"].cast("string"), value["j"])


def resource_text(key: str) -> Column:
    return as_text(F.try_element_at("resource_attrs", F.lit(key)))


def has_zero_starts(spans: DataFrame) -> bool:
    """Whether any span starts at 0; Parquet answers from the statistics of its row groups where none can."""
    return not spans.filter("start_ns = 0").limit(1).isEmpty()


def units(spans: DataFrame, policies: list[Named] | tuple[Named, ...] = (), zero_starts: bool | None = None) -> DataFrame:
    """One row for each unit: totals of its spans, policy aggregates and recorded resource values.

    ``control`` is null for data; for a decision that another instance sent it
    is the decision.  A start of 0 also means that none is known: a later one
    replaces it, so the earliest start of a unit is the least after its last 0,
    or 0 if nothing follows.  Without zeros it is a plain minimum; unless told
    by ``zero_starts``, the spans are asked for them.  Spans are not gathered in
    either case.
    """
    start = F.min("start_ns")
    if has_zero_starts(spans) if zero_starts is None else zero_starts:
        place = F.struct("scope_idx", "span_idx")
        zeros = spans.filter("start_ns = 0").groupBy(*UNIT).agg(F.max(place).alias("_zero"))
        spans = spans.join(zeros, list(UNIT), "left")
        start = F.coalesce(F.min(F.when(F.col("_zero").isNull() | (place > F.col("_zero")), F.col("start_ns"))), F.lit(0).cast("long"))
    extra = [c.alias(n) for i, p in enumerate(policies) for n, c in p.policy.aggregates(f"_p{i}_").items()]
    extra += [F.min(resource_text(p.record_from)).alias(f"_from{i}") for i, p in enumerate(policies) if p.record_from]
    is_control = F.map_contains_key("resource_attrs", F.lit(DECISION))
    control = F.when(is_control, F.coalesce(F.try_element_at("resource_attrs", F.lit(DECISION))["b"], F.lit(False)))
    return spans.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_spans"), start.alias("start_ns"), F.greatest(F.max("end_ns"), F.lit(0)).alias("end_ns"), F.bool_or(control).alias("control"), *extra)


def first_spans(spans: DataFrame) -> DataFrame:
    """The first span of each unit, in order of scope and span."""
    first = F.min_by(F.struct("span_id", "parent_span_id"), F.struct("scope_idx", "span_idx"))
    return spans.groupBy(*UNIT).agg(first.alias("s")).select(*UNIT, "s.span_id", "s.parent_span_id")


def services(spans: DataFrame) -> DataFrame:
    """The distinct service names of each trace in a batch, sorted; resources without one are skipped."""
    return spans.groupBy("batch_seq", "trace_id").agg(F.array_sort(F.collect_set(F.try_element_at("resource_attrs", F.lit("service.name"))["s"])).alias("services"))
