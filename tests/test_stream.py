"""The stateful stream: the same decisions and spans as the plan, wherever triggers fall, and eviction by time."""

import json
import random
import time

from test_decisions import LISTS_OF_POLICIES, stream_of

from tracewinnow.model import FLUSHES, SPAN, span
from tracewinnow.operators import metrics
from tracewinnow.operators.policies import Downgrader, Named, Static, StatusCode
from tracewinnow.plans.sampler import Sampler
from tracewinnow.streaming.sampler import blocking_times, flush_state, placeholders_of, sample_stream, spans_of


def replay(spark, rows, named, folder, files):
    batches = sorted({r["batch_seq"] for r in rows})
    for i in range(files):
        part = [r for r in rows if batches.index(r["batch_seq"]) * files // len(batches) == i]
        if part:
            spark.createDataFrame(part, SPAN).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            time.sleep(0.05)
    spans = spark.readStream.schema(SPAN).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = sample_stream(spans, named, bounded=True).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out").collect()
    return {r.trace_id: (r.decision, r.policy) for r in out if r.kind == "decision"}, sorted(json.loads(r.span)["span_id"] for r in out if r.kind == "span")


def test_stream_equals_plan(spark, tmp_path):
    for k, named in enumerate(LISTS_OF_POLICIES):
        rows = stream_of(random.Random(11), 12, 9, controls=True)
        plan = Sampler(spark.createDataFrame(rows, SPAN), named)
        want = {r.trace_id: (r.decision, r.policy) for r in plan.decisions.filter("decision <> 'Pending'").collect()}
        spans = sorted(r.span_id for r in plan.sampled.collect())
        for files in (1, 3):
            assert replay(spark, rows, named, f"{tmp_path}/{k}-{files}", files) == (want, spans)


def test_eviction_by_time(spark, tmp_path):
    rows = stream_of(random.Random(2), 3, 2)
    spark.createDataFrame(rows, SPAN).write.parquet(f"{tmp_path}/in")
    out = sample_stream(spark.readStream.schema(SPAN).parquet(f"{tmp_path}/in"), [Named("none", Static("Pending"))], primary_ttl_ms=1000)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        want = {r["trace_id"] for r in rows}
        for _ in range(60):
            time.sleep(1)
            try:
                got = spark.read.parquet(f"{tmp_path}/out").filter("kind = 'decision'").collect()
            except Exception:  # noqa: BLE001 - nothing is written yet
                continue
            if len(got) == len(want):
                break
        assert {(r.trace_id, r.decision, r.policy) for r in got} == {(t, "NotSampled", "evicted") for t in want}
    finally:
        q.stop()


def test_export_and_flush(spark, tmp_path):
    """What goes downstream has no flush counts; a dropped trace leaves a placeholder; held spans and decisions come back from the state."""
    kept, gone, held = "1a" * 16, "2b" * 16, "3c" * 16
    rows = [span(kept, "1", resource={FLUSHES: 2}), span(kept, "2", batch_seq=1, status="ERROR"), span(kept, "3", batch_seq=2), span(gone, "4", status="OK"), span(held, "5", resource={FLUSHES: 5, "k": "v"}), span("bad", "6")]
    spark.createDataFrame(rows, SPAN).coalesce(1).write.parquet(f"{tmp_path}/in")
    named = [Named("errors", StatusCode(("ERROR",))), Named("no", Downgrader("NotSampled", StatusCode(("OK",))), emit_placeholder=True)]
    out = sample_stream(spark.readStream.schema(SPAN).parquet(f"{tmp_path}/in"), named, bounded=True)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    sent = spans_of(out).orderBy("emit_seq").collect()
    assert [(r.span_id, r.emit_seq) for r in sent] == [("1", 0), ("2", 1), ("3", 2)] and all(FLUSHES not in r.resource_attrs for r in sent)
    assert [(r.trace_id, r.attrs["sampling.policy"].s) for r in placeholders_of(out, 9_000_000_000).collect()] == [(gone, "no")]
    spans, told = flush_state(spark, f"{tmp_path}/state")
    assert [(r.span_id, r.resource_attrs[FLUSHES].i, r.resource_attrs["k"].s) for r in spans.collect()] == [("5", 6, "v")]
    assert {r.trace_id for r in told.collect()} == {kept, gone}
    waits = blocking_times(spark, q.recentProgress)
    assert waits.count() >= 1 and metrics.histogram(waits, "ns").agg({"n": "sum"}).first()[0] == waits.count()
