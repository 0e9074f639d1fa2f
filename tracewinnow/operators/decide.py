"""From units to decisions: running totals, ordered policies, low priority and decision memory.

While a trace is undecided all its units before are pending, so the totals that
policies see at a unit are running aggregates of the trace, and its decision is
that of the first unit with a final one.  One shuffle on the trace id serves
the running window, the search for that unit and the per-trace result.

A policy list in which a low-priority decision can hide another one's (a
downgrader to LowPriority exists) needs the trace's history.  There, the rows,
which the window has sorted already, are passed through in Arrow batches with
one small state for the trace at hand, so a trace of any length takes linear
time and no memory.

With ``keep_batches`` an undecided trace is evicted, as not sampled, once so
many batches have gone by without one of its spans: what a bounded cache does,
with a bound that doesn't depend on other traces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import ids
from ..model import DECISIVE
from .policies import Downgrader, Named
from .units import units

FINAL = ("Sampled", "NotSampled")
EVICTED = "evicted"
ORDER = ("batch_seq", "rs_idx")


def running(unit_rows: DataFrame, keep_batches: int | None = None) -> DataFrame:
    """Adds ``cum_spans``, ``cum_start`` and ``cum_end``: the trace's totals up to each unit; control units add nothing.

    With ``keep_batches`` also ``evicted``: whether more batches than that went
    by since the trace's unit before.
    """
    ordered = Window.partitionBy("trace_id").orderBy(*ORDER)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    data = F.col("control").isNull()
    columns = {
        "cum_spans": F.coalesce(F.sum(F.when(data, F.col("n_spans"))).over(upto), F.lit(0)),
        "cum_start": F.min(F.when(data, F.col("start_ns"))).over(upto),
        "cum_end": F.max(F.when(data, F.col("end_ns"))).over(upto),
    }
    if keep_batches is not None:
        columns["evicted"] = F.coalesce(F.col("batch_seq") - F.lag("batch_seq").over(ordered) > keep_batches, F.lit(False))
    return unit_rows.withColumns(columns)


def remembers_low(policies: list[Named]) -> bool:
    """Whether a low-priority decision of one policy can meet one of another."""
    return any(isinstance(p.policy, Downgrader) and p.policy.to == "LowPriority" for p in policies)


def evaluated(spans: DataFrame, policies: list[Named], zero_starts: bool | None = None, keep_batches: int | None = None) -> DataFrame:
    """Units with the decision of every policy, ``_d0``, ``_d1``, ..., before any is hidden."""
    rows = running(units(spans, policies, zero_starts), keep_batches)
    rows = ids.with_hash64(rows, sorted({s for p in policies for s in p.policy.salts()}))
    return rows.withColumns({f"_d{i}": p.policy.decision(f"_p{i}_") for i, p in enumerate(policies)}) if policies else rows


def _by_window(rows: DataFrame, policies: list[Named]) -> DataFrame:
    decision, policy, position = F.lit("Pending"), F.lit(None).cast("string"), F.lit(len(policies))
    for i in reversed(range(len(policies))):
        hit = F.col(f"_d{i}").isin(*DECISIVE)
        decision = F.when(hit, F.col(f"_d{i}")).otherwise(decision)
        policy = F.when(hit, F.lit(policies[i].name)).otherwise(policy)
        position = F.when(hit, F.lit(i + 1)).otherwise(position)
    told = F.when(F.col("control"), F.lit("Sampled")).when(~F.col("control"), F.lit("NotSampled"))
    data = F.col("control").isNull()
    decision, policy, position = F.coalesce(told, decision), F.when(data, policy), F.when(data, position).otherwise(0)
    if "evicted" in rows.columns:  # before the unit came, so nothing of it is looked at
        gone = F.col("evicted")
        decision, policy, position = F.when(gone, F.lit("NotSampled")).otherwise(decision), F.when(gone, F.lit(EVICTED)).otherwise(policy), F.when(gone, F.lit(0)).otherwise(position)
    rows = rows.withColumns({"decision": decision, "policy": policy, "position": position, "effective": F.array(*[F.col(f"_d{i}") for i in range(len(policies))]).cast("array<string>")})
    whole = Window.partitionBy("trace_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("late", F.coalesce(F.bool_or(F.col("decision").isin(*FINAL)).over(whole), F.lit(False)))


def _by_scan(rows: DataFrame, policies: list[Named]) -> DataFrame:
    names = [p.name for p in policies]
    rows = rows.withColumn("_vector", F.array(*[F.col(f"_d{i}") for i in range(len(names))]).cast("array<string>"))
    keep = [c for c in rows.columns if not c.startswith(("_d", "_hash_"))]
    rows = rows.select(*keep).sortWithinPartitions("trace_id", *ORDER)  # as the window has left them, so nothing is sorted again
    new = [T.StructField("decision", T.StringType()), T.StructField("policy", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("effective", T.ArrayType(T.StringType())), T.StructField("late", T.BooleanType()), T.StructField("_last_low", T.StringType())]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace, done, low = None, False, None
        for batch in batches:
            out: list[tuple] = []
            evicted = batch.column("evicted").to_pylist() if "evicted" in batch.schema.names else [False] * batch.num_rows
            for own, vector, control, gone in zip(*(batch.column(c).to_pylist() for c in ("trace_id", "_vector", "control")), evicted):
                if own != trace:
                    trace, done, low = own, False, None
                seen = ["Pending" if d == "LowPriority" and low not in (None, name) else d for d, name in zip(vector, names)]
                first = next((i for i, d in enumerate(seen) if d in DECISIVE), None)
                if gone:
                    decision, policy, position = "NotSampled", EVICTED, 0
                elif control is not None:
                    decision, policy, position = FINAL[not control], None, 0
                elif first is None:
                    decision, policy, position = "Pending", None, len(names)
                else:
                    decision, policy, position = seen[first], names[first], first + 1
                late = done
                if not done:
                    done = decision in FINAL
                    low = (low or policy) if decision == "LowPriority" else None
                out.append((decision, policy, position, seen, late, low))
            added = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(f.name for f in new)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *new])).drop("_vector")


def unit_decisions(spans: DataFrame, policies: list[Named], zero_starts: bool | None = None, keep_batches: int | None = None) -> DataFrame:
    """Units with ``decision``, ``policy``, ``position`` (policies evaluated), ``effective`` (their decisions) and ``late``.

    ``late``: the trace was decided before; such a unit follows that decision
    and its own columns say nothing.  With ``keep_batches`` the unit that finds
    its trace evicted carries that decision.
    """
    rows = evaluated(spans, policies, zero_starts, keep_batches)
    return _by_scan(rows, policies) if remembers_low(policies) else _by_window(rows, policies)


def trace_decisions(unit_rows: DataFrame, last_kept: int | None = None) -> DataFrame:
    """One row for each trace: its final decision, the policy that made it (null for one told by another instance) and where; Pending if there is none.

    With ``last_kept`` an undecided trace whose last unit came in an earlier
    batch is evicted, at no place.
    """
    final = F.col("decision").isin(*FINAL) & ~F.col("late")
    last = F.struct("decision", "policy", *ORDER)
    told = F.col("control").isNotNull() & ~F.coalesce(F.col("policy") == EVICTED, F.lit(False))
    out = unit_rows.groupBy("trace_id").agg(F.min_by(F.when(final, last), F.when(final, F.struct(*ORDER))).alias("d"), F.bool_or(final & told).alias("told"), F.max("batch_seq").alias("latest"))
    gone = F.col("d").isNull() & (F.col("latest") < last_kept) if last_kept is not None else F.lit(False)
    decision = F.when(gone, F.lit("NotSampled")).otherwise(F.coalesce("d.decision", F.lit("Pending")))
    policy = F.when(gone, F.lit(EVICTED)).otherwise(F.col("d.policy"))
    return out.select("trace_id", decision.alias("decision"), policy.alias("policy"), "d.batch_seq", "d.rs_idx", F.coalesce("told", F.lit(False)).alias("told"))


def known_first(sampled: DataFrame, not_sampled: DataFrame) -> DataFrame:
    """Two decision memories as one: a trace in both counts as sampled."""
    both = sampled.select("trace_id", F.lit(1).alias("s")).unionByName(not_sampled.select("trace_id", F.lit(0).alias("s")))
    return both.groupBy("trace_id").agg(F.when(F.max("s") == 1, F.lit("Sampled")).otherwise(F.lit("NotSampled")).alias("decision"))
