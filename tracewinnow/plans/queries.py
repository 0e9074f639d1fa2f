"""The registered queries over the provided tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..model import ATTR, DECISION, FLUSHES, SPAN
from ..operators import decide, export, metrics, regulator
from ..operators import units as unit_ops
from ..operators.exact import exact_states
from ..operators.policies import And, Condition, Downgrader, Latency, Named, Probabilistic, RemoteProbabilistic, RootSpans, SpanCount, StatusCode, Threshold
from ..sources.events import events_spans
from ..sources.spans import flatten, nest
from ..sources.tables import shared_dir, stored
from ..streaming.sampler import flush_state, placeholders_of, sample_stream, spans_of
from .sampler import Sampler

SIX_HOURS_MS = 6 * 3600 * 1000
NOW_NS = 1_700_000_000_000_000_000


def flagship() -> list[Named]:
    return [
        Named("consistent", Threshold()),
        Named("half-of-errors", And((Probabilistic("", 50), StatusCode(("ERROR",)))), record_from="service.name", mappings=(("^svc-[01]$", "svc-low"),)),
        Named("lone-roots", RootSpans(Probabilistic("", 10))),
        Named("large", Downgrader("NotSampled", SpanCount(5)), emit_placeholder=True, record_from="service.name"),
        Named("slow", Latency(SIX_HOURS_MS)),
    ]


def with_low_priority() -> list[Named]:
    return [Named("low-errors", Downgrader("LowPriority", StatusCode(("ERROR",)))), Named("low-pairs", Downgrader("LowPriority", SpanCount(2))), Named("large", SpanCount(4)), Named("slow", Latency(SIX_HOURS_MS))]


def hex64(x):
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def sampler(spark: SparkSession, sf_dir: str, named: list[Named] | None = None, **options) -> Sampler:
    return Sampler(events_spans(spark, sf_dir), named or flagship(), zero_starts=False, **options)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_export(spark, sf_dir)


# --- functions ------------------------------------------------------------


def traces(spark, sf_dir):
    return events_spans(spark, sf_dir).select("trace_id").distinct()


def hash_fnv64(spark, sf_dir):
    rows = ids.with_hash64(traces(spark, sf_dir), ("", "sea-salt"))
    return rows.select("trace_id", hex64(ids.hash_column()).alias("hash"), hex64(ids.hash_column("sea-salt")).alias("salted"))


def shard_fnv32(spark, sf_dir):
    return traces(spark, sf_dir).select("trace_id", ids.shard(F.col("trace_id"), 5).alias("shard"))


def rv56(spark, sf_dir):
    return traces(spark, sf_dir).select("trace_id", ids.rv(F.col("trace_id")).alias("rv"))


def threshold_parse(spark, sf_dir):
    text = F.try_element_at("attrs", F.lit("sampling.tail.threshold"))["s"]
    return events_spans(spark, sf_dir).select("span_id", text.alias("text"), ids.parse_threshold(text).alias("threshold"))


def is_root(spark, sf_dir):
    return events_spans(spark, sf_dir).select("span_id", ids.is_root(F.col("trace_id"), F.col("parent_span_id")).alias("is_root"))


def duration_ms(spark, sf_dir):
    return events_spans(spark, sf_dir).select("span_id", ids.duration_ms(F.col("start_ns"), F.col("end_ns")).alias("ms"), ids.duration_ms(F.col("end_ns"), F.col("start_ns")).alias("back_ms"))


def first_span(spark, sf_dir):
    return unit_ops.first_spans(events_spans(spark, sf_dir))


def services_per_unit(spark, sf_dir):
    return unit_ops.services(events_spans(spark, sf_dir)).select("batch_seq", "trace_id", F.array_join("services", ",").alias("services"))


def decision_grouping(spark, sf_dir):
    named = Named("x", Threshold(), record_from="service.name", mappings=(("^svc-[01]$", "low"), ("svc", "any")))
    service = unit_ops.resource_text("service.name")
    return events_spans(spark, sf_dir).select("span_id", service.alias("service"), metrics.grouped(service, named).alias("grouped"))


# --- units and policies -----------------------------------------------------


def span_flatten(spark, sf_dir):
    """Spans nested into payloads and flattened again."""
    nested = nest(events_spans(spark, sf_dir))
    back = flatten(nested.select("batch_seq", "resource_spans"))
    return back.select("batch_seq", "trace_id", "span_id", "name", "start_ns", "scope_idx", "span_idx")


def nested_payloads(spark, sf_dir):
    payload = nest(events_spans(spark, sf_dir)).select("trace_id", "batch_seq", "rs_idx", F.explode("resource_spans").alias("r"))
    spans = F.flatten(F.transform("r.scope_spans", lambda s: s["spans"]))
    return payload.select("trace_id", "batch_seq", "rs_idx", F.size("r.scope_spans").alias("n_scopes"), F.array_join(F.transform(spans, lambda s: s["span_id"]), ",").alias("span_ids"))


def unit_metadata(spark, sf_dir):
    return unit_ops.units(events_spans(spark, sf_dir)).select(*unit_ops.UNIT, "n_spans", "start_ns", "end_ns")


def zero_starts(spark, sf_dir):
    """Units of spans of which some start at 0."""
    spans = events_spans(spark, sf_dir).withColumns({"start_ns": F.when(F.col("span_idx") % 3 == 0, F.lit(0)).otherwise(F.col("start_ns")), "rs_idx": F.lit(0)})
    return unit_ops.units(spans).select(*unit_ops.UNIT, "n_spans", "start_ns", "end_ns")


def running_metadata(spark, sf_dir):
    rows = decide.running(unit_ops.units(events_spans(spark, sf_dir), zero_starts=False))
    return rows.select(*unit_ops.UNIT, "cum_spans", "cum_start", "cum_end")


def policy_query(policy, name):
    def query(spark, sf_dir):
        return decide.evaluated(events_spans(spark, sf_dir), [Named(name, policy)], zero_starts=False).select(*unit_ops.UNIT, F.col("_d0").alias("decision"))

    return query


def remote(rate):
    p = RemoteProbabilistic("sea-salt", 10, "getter")
    p.start({"getter": lambda: rate})
    return p


CONDITIONS = Condition(('attributes["sampling.tail.threshold"] == "0x"', 'name == "error" and not IsRootSpan()', 'resource.attributes["service.name"] == "svc-3" and attributes["sampling.tail.threshold"] != nil'), ('name == "retry" and attributes["attempt"] == 2', 'name != "retry" and attributes["attempt"] != nil'))
POLICIES = {
    "policy_probabilistic": Probabilistic("", 33),
    "policy_remote_probabilistic": remote(25.0),
    "policy_span_count": SpanCount(3),
    "policy_latency": Latency(SIX_HOURS_MS),
    "policy_status_code": StatusCode(("ERROR", "OK")),
    "policy_ottl": CONDITIONS,
    "policy_threshold": Threshold(),
    "policy_and": And((Probabilistic("", 50), StatusCode(("ERROR",)))),
    "policy_root_spans": RootSpans(Probabilistic("", 10)),
    "policy_downgrader": Downgrader("NotSampled", SpanCount(3)),
}


# --- decisions --------------------------------------------------------------


def make_decision(spark, sf_dir):
    return sampler(spark, sf_dir).units.select(*unit_ops.UNIT, "decision", "policy", "late")


def trace_decision(spark, sf_dir):
    return sampler(spark, sf_dir).decisions.select("trace_id", "decision", "policy", "batch_seq", "rs_idx")


def low_priority_state(spark, sf_dir):
    return sampler(spark, sf_dir, with_low_priority()).units.filter("not late").select(*unit_ops.UNIT, "decision", "policy")


def policy_decisions_metric(spark, sf_dir):
    return sampler(spark, sf_dir).policy_decisions


def memory(spark, sf_dir):
    """Two decision memories that overlap: traces that start with 0 to 3, and with 3 to 5."""
    t = traces(spark, sf_dir)
    return t.filter("trace_id < '4'"), t.filter("trace_id >= '3' AND trace_id < '6'")


def decision_lookup(spark, sf_dir):
    known = decide.known_first(*memory(spark, sf_dir))
    return traces(spark, sf_dir).join(known, "trace_id", "left").select("trace_id", F.coalesce("decision", F.lit("Unspecified")).alias("decision"))


def early_prune(spark, sf_dir):
    emitted, left = export.early_prune(events_spans(spark, sf_dir), decide.known_first(*memory(spark, sf_dir)))
    return emitted.select("span_id", F.lit("emit").alias("route")).unionByName(left.select("span_id", F.lit("evaluate").alias("route")))


def late_spans(spark, sf_dir):
    """Spans that came after their trace's decision, and where they went."""
    s = sampler(spark, sf_dir).stored(units=True)
    late = s.units.filter("late").select(*unit_ops.UNIT)
    kept = s.decisions.select("trace_id", F.when(F.col("decision") == "Sampled", "emit").otherwise("drop").alias("route"))
    return s.spans.join(late, list(unit_ops.UNIT)).join(kept, "trace_id").select("span_id", "route")


# --- exports ----------------------------------------------------------------


def sampled_export(spark, sf_dir):
    return sampler(spark, sf_dir).sampled.select("trace_id", "span_id", "start_ns", "end_ns", "emit_seq")


def placeholder_spans(spark, sf_dir):
    rows = sampler(spark, sf_dir).placeholders(NOW_NS)
    return rows.select("trace_id", "name", "start_ns", "end_ns", F.try_element_at("resource_attrs", F.lit("service.name"))["s"].alias("service"), F.try_element_at("attrs", F.lit("sampling.policy"))["s"].alias("policy"))


def flushes(df):
    return F.try_element_at("resource_attrs", F.lit(FLUSHES))["i"].alias("flushes")


def flush_pending(spark, sf_dir):
    return sampler(spark, sf_dir).flushed.select("trace_id", "span_id", flushes(None))


def flush_reingest(spark, sf_dir):
    """Flushed spans met by a second sampler with one more policy: what is released has no count, the rest a count of 2."""
    first = stored(sampler(spark, sf_dir).flushed, "flushed")  # as it reaches the second one
    second = Sampler(first, [*flagship(), Named("pairs", SpanCount(2))], zero_starts=False).stored()
    both = second.sampled.select(*SPAN.names).unionByName(second.flushed.select(*SPAN.names))
    return both.select("trace_id", "span_id", flushes(None))


def decision_spans(spark, sf_dir):
    told = F.try_element_at("resource_attrs", F.lit(DECISION))["b"]
    return sampler(spark, sf_dir).decision_spans.select("trace_id", "name", told.alias("sampled"), "rs_idx")


def decision_span_ingest(spark, sf_dir):
    """Decisions of another instance for traces that start with ``a`` to ``d`` reach the sampler after batch 20."""
    told = F.struct(*[((F.col("trace_id") < "c") if f.name == "b" else F.lit(None)).cast(f.dataType).alias(f.name) for f in ATTR.fields])
    other = traces(spark, sf_dir).filter("trace_id >= 'a' AND trace_id < 'e'").select("trace_id", F.create_map(F.lit(DECISION), told).alias("resource_attrs"), F.lit(20).cast("long").alias("batch_seq"), F.lit(9).alias("rs_idx"))
    spans = events_spans(spark, sf_dir).unionByName(other, allowMissingColumns=True).select(*SPAN.names)
    return Sampler(spans, flagship(), zero_starts=False).decisions.select("trace_id", "decision", "policy", "told")


#: Batches without a span of it after which an undecided trace is evicted.
KEEP_BATCHES = 40


def with_bad_spans(spark, sf_dir):
    """Spans of which some have half a trace id."""
    bad = F.col("span_idx") % 97 == 0
    return events_spans(spark, sf_dir).withColumn("trace_id", F.when(bad, F.substring("trace_id", 1, 16)).otherwise(F.col("trace_id")))


def counters(spark, sf_dir):
    """Counts over spans of which some can't be used, with traces that are evicted."""
    return Sampler(with_bad_spans(spark, sf_dir), flagship(), zero_starts=False, keep_batches=KEEP_BATCHES).counters


def evicted_traces(spark, sf_dir):
    """Decisions where undecided traces are evicted: by the next unit, or at the end."""
    return Sampler(with_bad_spans(spark, sf_dir), flagship(), zero_starts=False, keep_batches=KEEP_BATCHES).decisions.select("trace_id", "decision", "policy", "batch_seq", "rs_idx")


def blocking_histogram(spark, sf_dir):
    values = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("value") * 10_000_000).cast("long").alias("ns"))
    return metrics.histogram(values, "ns")


def gauge_last(spark, sf_dir):
    """The age in batches of the trace that was evicted last."""
    units = Sampler(with_bad_spans(spark, sf_dir), flagship(), zero_starts=False, keep_batches=KEEP_BATCHES).units
    ages = metrics.eviction_ages(units).select(F.lit("primary").alias("cache"), "age", F.struct("batch_seq", "trace_id").alias("at"))
    return metrics.last_value(ages, ["cache"], "age", "at")


def regulator_steps(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 501 + 500).alias("size"), (F.floor(F.col("value") * 100) + 8000).cast("long").alias("heap"))
    return rows.select("event_id", regulator.next_size_column(F.col("size"), F.col("heap"), 10_000, 500, 1000).alias("new_size"))


def cache_tier(spark, sf_dir):
    """The tier that holds each undecided trace: the second one while all its units were low priority."""
    rows = sampler(spark, sf_dir, with_low_priority()).units
    open_ = rows.groupBy("trace_id").agg(F.bool_or(F.col("decision").isin(*decide.FINAL)).alias("final"), F.bool_and(F.col("decision") == "LowPriority").alias("low"))
    return open_.filter("not final").select("trace_id", F.when(F.col("low"), "secondary").otherwise("primary").alias("tier"))


def lru_exact(spark, sf_dir):
    """The exact sequence with small caches.  Conformance only: it runs in one task."""
    from ..config import from_dict

    config = from_dict({"primary_cache_size": 200, "secondary_cache_size": 20, "decision_cache": {"sampled_cache_size": 500, "non_sampled_cache_size": 500}, "policies": [{"name": "consistent", "type": "threshold"}, {"name": "roots", "type": "root_spans", "root_spans": {"sub_policy": {"type": "probabilistic", "probabilistic": {"sampling_percentage": 10}}}}, {"name": "slow", "type": "latency", "latency": {"threshold_ms": SIX_HOURS_MS}}]})
    return exact_states(events_spans(spark, sf_dir), config)


def run_stream(spark, sf_dir, name):
    """The stateful stream over the spans as files, run until all are read; its output and the folder of its state."""
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    events_spans(spark, sf_dir).write.parquet(f"{base}/in")  # a trace's spans are in one file, so their triggers' order doesn't matter
    spans = spark.readStream.schema(SPAN).parquet(f"{base}/in")
    query = sample_stream(spans, flagship(), bounded=True).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out"), f"{base}/state"


def stream_decisions(spark, sf_dir):
    """Final decisions of the stream."""
    return run_stream(spark, sf_dir, "stream")[0].filter("kind = 'decision'").select("trace_id", "decision", "policy")


def stream_export(spark, sf_dir):
    """Spans and placeholders that the stream sends on."""
    out, _ = run_stream(spark, sf_dir, "stream-export")
    spans = spans_of(out).select("trace_id", "span_id", "name", "emit_seq")
    marks = placeholders_of(out, NOW_NS).select("trace_id", F.lit(None).cast("string").alias("span_id"), "name", F.lit(None).cast("int").alias("emit_seq"))
    return spans.unionByName(marks)


def stream_flush(spark, sf_dir):
    """What a stopped stream still holds: pending spans with their flush count, and its decisions as spans."""
    _, state = run_stream(spark, sf_dir, "stream-flush")
    held, told = flush_state(spark, state)
    pending = held.select("trace_id", "span_id", "name", flushes(None), F.lit(None).cast("boolean").alias("sampled"))
    decided = told.select("trace_id", F.lit(None).cast("string").alias("span_id"), "name", F.lit(None).cast("long").alias("flushes"), F.try_element_at("resource_attrs", F.lit(DECISION))["b"].alias("sampled"))
    return pending.unionByName(decided)


QUERIES = {
    f.__name__: f
    for f in (
        hash_fnv64, shard_fnv32, rv56, threshold_parse, is_root, duration_ms, first_span, services_per_unit, decision_grouping, span_flatten, nested_payloads, unit_metadata, zero_starts, running_metadata,
        make_decision, trace_decision, low_priority_state, policy_decisions_metric, decision_lookup, early_prune, late_spans, sampled_export, placeholder_spans, flush_pending, flush_reingest,
        decision_spans, decision_span_ingest, counters, evicted_traces, blocking_histogram, gauge_last, regulator_steps, cache_tier, lru_exact, stream_decisions, stream_export, stream_flush,
    )
} | {name: policy_query(p, name) for name, p in POLICIES.items()}
