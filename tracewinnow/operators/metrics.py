"""Counters and gauges of a run, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .policies import Named

#: Upper bounds of the blocking-time histogram, in nanoseconds.  Fixed values.
BLOCKING_BOUNDS = (500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000, 100_000_000, 1_000_000_000, 1_500_000_000, 3_000_000_000, 5_000_000_000)


def grouped(value: Column, policy: Named) -> Column:
    """The value of the first mapping whose pattern is found in ``value``, else ``value``."""
    out = value
    for pattern, group in reversed(policy.mappings):
        out = F.when(value.rlike(pattern), F.lit(group)).otherwise(out)
    return out


def policy_decisions(unit_rows: DataFrame, policies: list[Named]) -> DataFrame:
    """Evaluations that were not pending, by policy, decision and, for final ones, where the decision came from."""
    sources = F.array(*[grouped(F.coalesce(F.col(f"_from{i}"), F.lit("")) if p.record_from else F.lit(""), p) for i, p in enumerate(policies)])
    names = F.array(*[F.lit(p.name) for p in policies])
    seen = F.slice(F.arrays_zip(names.alias("policy"), F.col("effective").alias("decision"), sources.alias("decision_from")), 1, F.greatest("position", F.lit(0)))
    rows = unit_rows.filter(~F.col("late") & F.col("control").isNull()).select(F.explode(seen).alias("e")).select("e.*").filter("decision <> 'Pending'")
    source = F.when(F.col("decision").isin("Sampled", "NotSampled"), F.col("decision_from"))
    return rows.groupBy("policy", "decision", source.alias("decision_from")).agg(F.count(F.lit(1)).alias("n"))


def counters(decisions: DataFrame, bad_spans: DataFrame) -> DataFrame:
    """Traces sampled by a policy, traces evicted, and spans dropped because they can't be used.

    A policy's own decision not to sample isn't an eviction and isn't counted.
    """
    named = ~F.col("told")
    counted = decisions.agg(F.count_if(named & (F.col("decision") == "Sampled")).alias("traces_sampled"), F.count_if(named & (F.col("policy") == "evicted")).alias("traces_not_sampled"))
    dropped = bad_spans.agg(F.count(F.lit(1)).alias("dropped_spans"))
    return counted.join(dropped)  # of one row each


def eviction_ages(unit_rows: DataFrame) -> DataFrame:
    """What the age gauge of the trace cache is fed with: at which batch an evicted trace's next unit found it gone, and how many batches it had been held."""
    first = F.min("batch_seq").over(Window.partitionBy("trace_id"))
    return unit_rows.withColumn("first", first).filter("evicted AND NOT late").select("trace_id", "batch_seq", (F.col("batch_seq") - F.col("first")).alias("age"))


def observed(spans: DataFrame, name: str = "tracewinnow") -> tuple[DataFrame, Observation]:
    """``spans``, and an observation that holds their number and their last batch once they were written or counted."""
    own = Observation(name)
    return spans.observe(own, F.count(F.lit(1)).alias("spans"), F.max("batch_seq").alias("last_batch")), own


def histogram(values: DataFrame, column: str, bounds: tuple[int, ...] = BLOCKING_BOUNDS) -> DataFrame:
    """How many values fall up to each bound (inclusive) and above the last one: ``bucket`` counts bounds from 0."""
    bucket = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        bucket = F.when(F.col(column) <= bounds[i], F.lit(i)).otherwise(bucket)
    return values.filter(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def last_value(values: DataFrame, labels: list[str], value: str, at: str) -> DataFrame:
    """A gauge: the value recorded last for each set of labels."""
    return values.groupBy(*labels).agg(F.max_by(value, at).alias(value))
