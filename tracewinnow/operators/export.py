"""What leaves the sampler: released spans, placeholders, flushed spans and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ATTR, ATTRS, DECISION, FLUSHES, NO_PARENT, PLACEHOLDER_NAME, PLACEHOLDER_POLICY, PLACEHOLDER_SERVICE, SPAN
from .policies import Named


def is_control():
    return F.map_contains_key("resource_attrs", F.lit(DECISION))


def data_spans(spans: DataFrame) -> DataFrame:
    """Spans that carry data, not decisions of another instance."""
    return spans.filter(~F.coalesce(is_control(), F.lit(False)))


def without_flushes(spans: DataFrame) -> DataFrame:
    return spans.withColumn("resource_attrs", F.map_filter("resource_attrs", lambda k, v: k != FLUSHES))


def sampled_spans(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Data spans of sampled traces, before and after the decision, without flush counts.

    ``emit_seq`` orders payloads: 0 what was held when the decision fell, 1 the
    unit that made it, 2 what came later.
    """
    kept = decisions.filter("decision = 'Sampled'").select("trace_id", F.col("batch_seq").alias("_b"), F.col("rs_idx").alias("_r"))
    at, own = F.struct("_b", "_r"), F.struct("batch_seq", "rs_idx")
    seq = F.when(own < at, 0).when(own == at, 1).otherwise(2)
    return without_flushes(data_spans(spans)).join(kept, "trace_id").withColumn("emit_seq", seq).drop("_b", "_r")


def placeholders(decisions: DataFrame, policies: list[Named], now_ns: int) -> DataFrame:
    """A span for each trace that a policy with placeholders did not sample."""
    names = [p.name for p in policies if p.emit_placeholder]
    return placeholder_spans(decisions.filter((F.col("decision") == "NotSampled") & F.col("policy").isin(*names) if names else F.lit(False)), now_ns)


def placeholder_spans(rows: DataFrame, now_ns: int) -> DataFrame:
    """A span for each row (trace_id, policy, batch_seq, rs_idx), one second long up to ``now_ns``.

    Its id is a hash of trace and policy, so that a rerun makes the same span.
    """
    text = lambda v: F.struct(v.alias("s"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in ATTR.fields[1:]])
    span = {
        "batch_seq": F.col("batch_seq"),
        "rs_idx": F.col("rs_idx"),
        "scope_idx": F.lit(0),
        "span_idx": F.lit(0).cast("long"),
        "resource_attrs": F.create_map(F.lit("service.name"), text(F.lit(PLACEHOLDER_SERVICE))),
        "span_id": F.lpad(F.lower(F.hex(F.xxhash64("trace_id", "policy"))), 16, "0"),
        "parent_span_id": F.lit(NO_PARENT),
        "name": F.lit(PLACEHOLDER_NAME),
        "start_ns": F.lit(now_ns - 1_000_000_000).cast("long"),
        "end_ns": F.lit(now_ns).cast("long"),
        "status": F.lit("UNSET"),
        "attrs": F.create_map(F.lit(PLACEHOLDER_POLICY), text(F.col("policy"))),
        "trace_id": F.col("trace_id"),
    }
    return rows.select(*[span.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SPAN.fields])


def raised(spans: DataFrame) -> DataFrame:
    """Spans with their resource's flush count raised by 1; a missing one becomes 1."""
    before = F.coalesce(F.try_element_at("resource_attrs", F.lit(FLUSHES))["i"], F.lit(0).cast("long"))
    count = F.struct(*[(before + 1 if f.name == "i" else F.lit(None).cast(f.dataType)).alias(f.name) for f in ATTR.fields])
    attrs = F.map_concat(F.map_filter(F.coalesce("resource_attrs", F.create_map().cast(ATTRS)), lambda k, v: k != FLUSHES), F.create_map(F.lit(FLUSHES), count))
    return spans.withColumn("resource_attrs", attrs)


def flushed_spans(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Data spans of traces without a final decision, their resource's flush count raised by 1."""
    known = decisions.filter("decision IN ('Sampled', 'NotSampled')").select("trace_id")
    return raised(data_spans(spans).join(known, "trace_id", "left_anti"))


def decision_spans(decisions: DataFrame) -> DataFrame:
    """A span named ``decision`` for each final decision, which it carries as a resource attribute: sampled ones under resource 0, others under 1."""
    sampled = F.col("decision") == "Sampled"
    value = F.struct(*[(sampled if f.name == "b" else F.lit(None).cast(f.dataType)).alias(f.name) for f in ATTR.fields])
    own = {"trace_id": F.col("trace_id"), "name": F.lit("decision"), "resource_attrs": F.create_map(F.lit(DECISION), value), "rs_idx": F.when(sampled, 0).otherwise(1)}
    rows = decisions.filter("decision IN ('Sampled', 'NotSampled')")
    return rows.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SPAN.fields])


def early_prune(spans: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of traces that memory knows: those to emit at once, and those left to evaluate.

    Goes before the shuffle by trace.  Decisions of other instances are never
    pruned.  Spark broadcasts ``known`` where its size allows.
    """
    control = F.coalesce(is_control(), F.lit(False))
    sampled = known.filter("decision = 'Sampled'").select("trace_id")
    data = spans.filter(~control)
    emitted = without_flushes(data.join(sampled, "trace_id", "left_semi"))
    return emitted, data.join(known.select("trace_id"), "trace_id", "left_anti").unionByName(spans.filter(control))
