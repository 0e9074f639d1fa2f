"""State of the stream: few calls for many traces, long traces in parts, and what a stream with times to live leaves behind."""

import json
import time

import pandas as pd
from pyspark.sql import functions as F

from tracewinnow.model import SPAN, span
from tracewinnow.operators.policies import Named, SpanCount, StatusCode
from tracewinnow.plans.queries import run_stream
from tracewinnow.streaming.sampler import CELL_CHARS, INLINE, SLOTS, TraceState, flush_state, sample_stream


class Table:
    """A map state in memory that counts calls."""

    def __init__(self):
        self.rows, self.calls, self.cells = {}, 0, 0

    def exists(self):
        return bool(self.rows)

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.cells += sum(len(v) for v in value if isinstance(v, list))
        self.rows[key] = tuple(list(v) if isinstance(v, list) else v for v in value)

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]


class Handle:
    def __init__(self):
        self.tables, self.timers = {}, set()

    def getMapState(self, name, key, value, ttl=None):
        return self.tables.setdefault(name, Table())

    def registerTimer(self, at):
        self.timers.add(at)


class At:
    def __init__(self, ms):
        self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: ms


def state(named, bounded=True):
    handle, s = Handle(), TraceState(named, 1000, 100, 5000, bounded)
    s.init(handle)
    return s, handle


def fed(s, rows, ms=0):
    pdf = pd.DataFrame([(7, int(r["trace_id"], 16) % SLOTS, r["trace_id"], json.dumps(r)) for r in rows], columns=["bucket", "slot", "trace_id", "span"])
    out = pd.concat(list(s.handleInputRows((7,), iter([pdf[:3], pdf[3:]]), At(ms))))
    return [(r.trace_id, r.kind, r.emit_seq, json.loads(r.span)["span_id"] if r.span else r.decision) for r in out.itertuples()]


def test_calls_do_not_grow_with_decided_traces():
    s, handle = state([Named("errors", StatusCode(("ERROR",)))])
    out = fed(s, [span(f"{i:032x}", str(i), status="ERROR") for i in range(3000)] + [span(f"{i:032x}", str(i)) for i in range(3000, 3010)])
    assert len(out) == 6000 and handle.tables["decision"].calls <= SLOTS
    assert sum(t.calls for t in handle.tables.values()) <= SLOTS + 10
    late = fed(s, [span(f"{i:032x}", "x", batch_seq=1) for i in range(3000)])
    assert sorted(late) == sorted((f"{i:032x}", "span", 2, "x") for i in range(3000))


def test_long_undecided_trace():
    """Spans that came over many triggers are written a bounded number of times and released in order."""
    t, n = "ab" * 16, 40 * INLINE
    s, handle = state([Named("many", SpanCount(n + 1))])
    for i in range(n):
        assert fed(s, [span(t, str(i), batch_seq=i)]) == []
    assert handle.tables["totals"].cells + handle.tables["held"].cells <= (INLINE + 2) * n
    assert fed(s, [span(t, "last", batch_seq=n)]) == [(t, "span", 0, str(i)) for i in range(n)] + [(t, "span", 1, "last"), (t, "decision", None, "Sampled")]
    assert not handle.tables["totals"].rows and not handle.tables["held"].rows


def test_times_to_live():
    """A trace touched again is evicted by its new time only; a decision is forgotten by its own time, not by its neighbours'."""
    a, b = "00" * 16, f"{SLOTS:032x}"  # of one slot
    s, handle = state([Named("errors", StatusCode(("ERROR",)))], bounded=False)
    fed(s, [span(a, "1")], 0)
    fed(s, [span(a, "2", batch_seq=1)], 600)
    assert handle.timers == {1000, 1600}
    gone = lambda at: [tuple(r)[:4] for r in pd.concat(list(s.handleExpiredTimer((7,), At(at + 1), At(at)))).itertuples(index=False)]
    assert gone(1000) == [] and gone(1600) == [(a, "decision", "NotSampled", "evicted")] and not handle.tables["totals"].rows and not handle.tables["due"].rows
    assert fed(s, [span(b, "3", status="ERROR", batch_seq=2)], 4000)[-1] == (b, "decision", None, "Sampled")
    assert fed(s, [span(a, "4", status="ERROR", batch_seq=3)], 6000) == []
    assert [x[3] for x in fed(s, [span(a, "5", status="ERROR", batch_seq=4), span(b, "6", batch_seq=4)], 7000)] == ["5", "Sampled", "6"]


def test_flush_with_times_to_live(spark, tmp_path):
    kept, held = "1a" * 16, "3c" * 16
    rows = [span(kept, "1", status="ERROR"), *[span(held, f"h{i}") for i in range(INLINE + 1)]]
    spark.createDataFrame(rows, SPAN).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = sample_stream(spark.readStream.schema(SPAN).parquet(f"{tmp_path}/in"), [Named("errors", StatusCode(("ERROR",)))])
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    for _ in range(90):  # timers keep such a query busy, so it is never done
        time.sleep(1)
        if any(p["numInputRows"] for p in q.recentProgress):
            break
    q.stop()
    spans, told = flush_state(spark, f"{tmp_path}/state")
    assert sorted(r.span_id for r in spans.collect()) == sorted(f"h{i}" for i in range(INLINE + 1))
    assert [r.trace_id for r in told.collect()] == [kept]


def test_calls_do_not_grow_with_undecided_traces():
    s, handle = state([Named("many", SpanCount(3))])
    ids = [f"{i:032x}" for i in range(3000)]
    for seq in range(2):
        before = sum(t.calls for t in handle.tables.values())
        assert fed(s, [span(t, str(seq), batch_seq=seq) for t in ids]) == []
        assert sum(t.calls for t in handle.tables.values()) - before <= 2 * SLOTS
    out = fed(s, [span(t, "2", batch_seq=2) for t in ids])
    assert sorted(out, key=lambda r: r[0]) == [r for t in ids for r in ((t, "span", 0, "0"), (t, "span", 0, "1"), (t, "span", 1, "2"), (t, "decision", None, "Sampled"))]
    assert not handle.tables["totals"].rows and not handle.tables["held"].rows


def test_wide_entry():
    """Where undecided traces of an entry hold much, what a trigger writes again stays short."""
    s, handle = state([Named("pair", SpanCount(2))])
    ids = [f"{i * SLOTS:032x}" for i in range(200)]  # of one slot
    for i, t in enumerate(ids):
        assert fed(s, [span(t, "a", name="x" * 2000, batch_seq=i)]) == []
        assert [len(text) <= CELL_CHARS + 250 * len(ids) for (text,) in handle.tables["totals"].rows.values()] == [True]  # all spans: over 400,000
    out = [r for i, t in enumerate(ids) for r in fed(s, [span(t, "b", batch_seq=200 + i)])]
    assert out == [r for t in ids for r in ((t, "span", 0, "a"), (t, "span", 1, "b"), (t, "decision", None, "Sampled"))]
    assert not handle.tables["totals"].rows and not handle.tables["held"].rows


def test_eviction_within_an_entry():
    a, b, c = (f"{i * SLOTS:032x}" for i in range(3))  # of one slot
    s, handle = state([Named("errors", StatusCode(("ERROR",)))], bounded=False)
    fed(s, [span(t, "1") for t in (a, b, c)], 0)
    fed(s, [span(b, "2", batch_seq=1)], 600)
    gone = lambda at: [r.trace_id for o in s.handleExpiredTimer((7,), At(at + 1), At(at)) for r in o.itertuples()]
    assert gone(1000) == [a, c]
    assert fed(s, [span(t, "3", status="ERROR", batch_seq=2) for t in (a, b)], 1200) == [(b, "span", 0, "1"), (b, "span", 0, "2"), (b, "span", 1, "3"), (b, "decision", None, "Sampled")]
    assert gone(1600) == [] and not handle.tables["totals"].rows


def test_flush_of_odd_text(spark, tmp_path):
    """Held spans come back as they came, whatever their text."""
    odd = ['"quoted" \\ and\n\t\x01', "é\u2028\U0001f600", "", '{"a": [1]}']
    rows = [span(f"{i:032x}", f"{i}-{k}", name=name, resource={"k": name}) for i, name in enumerate(odd) for k in range(2)]
    spark.createDataFrame(rows, SPAN).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = sample_stream(spark.readStream.schema(SPAN).parquet(f"{tmp_path}/in"), [Named("many", SpanCount(9))], bounded=True)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    spans, told = flush_state(spark, f"{tmp_path}/state")
    assert sorted((r.span_id, r.name, r.resource_attrs["k"].s) for r in spans.collect()) == sorted((r["span_id"], r["name"], r["name"]) for r in rows)
    assert told.count() == 0


def test_input_files_hold_whole_traces(spark):
    """The queries' stream may meet its files in any order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, state = run_stream(spark, "/root/testdata/sf0.001", "files")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    places = spark.read.parquet(f"{state.removesuffix('/state')}/in").select("trace_id", "_metadata.file_path").distinct()
    assert 1 < places.select("file_path").distinct().count() < places.count() == places.select("trace_id").distinct().count()
