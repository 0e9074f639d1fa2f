"""Ordered policies, low priority, metrics and the whole plan against the sequential sampler."""

import hashlib
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracewinnow.config import Config
from tracewinnow.model import DECISION, FLUSHES, SPAN, span
from tracewinnow.operators import decide, export, metrics
from tracewinnow.operators.exact import ExactSampler, Outcome, batches, decide as decide_unit
from tracewinnow.operators.policies import And, Downgrader, Latency, Named, Probabilistic, RootSpans, SpanCount, Static, StatusCode, Threshold, Unit
from tracewinnow.plans.queries import flagship, with_low_priority
from tracewinnow.plans.sampler import Sampler
from tracewinnow.sources.spans import forward

T = [hashlib.md5(b"trace %d" % i).hexdigest() for i in range(4)]
KIND = {"P": Static("Pending"), "S": Static("Sampled"), "N": Static("NotSampled"), "L": Static("LowPriority"), "X": Static("Unspecified", True)}
LISTS = [
    ("PS", None, "Sampled", 1, [("p1", "Sampled", "")]),
    ("P", None, "Pending", None, []),
    ("PN", None, "NotSampled", 1, [("p1", "NotSampled", "")]),
    ("SL", None, "Sampled", 0, [("p0", "Sampled", "")]),
    ("NS", None, "NotSampled", 0, [("p0", "NotSampled", "")]),
    ("LS", None, "LowPriority", 0, [("p0", "LowPriority", None)]),
    ("X", None, "Pending", None, [("p0", "Unspecified", None)]),
    ("XS", None, "Sampled", 1, [("p0", "Unspecified", None), ("p1", "Sampled", "")]),
    ("SLP", "p1", "Sampled", 0, [("p0", "Sampled", "")]),
    ("PLP", "p0", "Pending", None, []),
    ("LP", "p1", "Pending", None, []),
]


@pytest.mark.parametrize("kinds, last_low, decision, by, points", LISTS)
def test_first_decisive(spark, kinds, last_low, decision, by, points):
    named = [Named(f"p{i}", KIND[k]) for i, k in enumerate(kinds)]
    own = [span(T[0], "1")]
    got = decide_unit(Unit(T[0], own, 1, 0, 0, last_low), named, {})
    assert got == Outcome(decision, named[by] if by is not None else None, points)
    if last_low is None:
        s = Sampler(spark.createDataFrame(own, SPAN), named)
        assert [tuple(r) for r in s.units.select("decision", "policy").collect()] == [(decision, f"p{by}" if by is not None else None)]
        assert sorted(map(tuple, s.policy_decisions.select("policy", "decision", "decision_from").collect())) == sorted(points)


@pytest.mark.parametrize(
    "service, mappings, want",
    [
        ("orders-7", (), "orders-7"),
        ("orders-7", (("^orders-[0-9]+$", "orders"),), "orders"),
        ("billing", (("^orders", "orders"), ("ill", "money")), "money"),
        ("billing", (("^orders", "orders"),), "billing"),
        ("", (("^orders", "orders"),), ""),
        ("", (("^$", "unnamed"),), "unnamed"),
        ("orders-eu", (("eu$", "europe"), ("^orders", "orders")), "europe"),
        ("orders-eu", (("^orders", "orders"), ("eu$", "europe")), "orders"),
    ],
)
def test_decision_from(spark, service, mappings, want):
    named = [Named("p", Static("Pending")), Named("s", Static("Sampled"), record_from="service.name", mappings=mappings)]
    own = [span(T[0], "1", resource={"service.name": service})]
    assert Sampler(spark.createDataFrame(own, SPAN), named).policy_decisions.collect()[0].decision_from == want
    assert decide_unit(Unit(T[0], own, 1, 0, 0), named, own[0]["resource_attrs"]).counted == [("s", "Sampled", want)]


def stream_of(rng: random.Random, traces: int, batch_count: int, controls: bool = False) -> list[dict]:
    out = []
    for b in range(batch_count):
        for rs in range(rng.randint(1, 3)):
            control, told = controls and rng.random() < 0.1, rng.random() < 0.5
            for i in range(rng.randint(1, 4)):
                tid = f"{rng.randrange(traces):032x}"
                if control:
                    out.append(span(tid, "d", batch_seq=b, rs_idx=rs, span_idx=i, resource={DECISION: told}))
                    continue
                start = rng.choice([0, rng.randint(1, 9)]) * 10**9
                out.append(span(tid, f"{len(out):016x}", rng.choice(["0" * 16, tid[16:], "00000000000000aa"]), batch_seq=b, rs_idx=rs, scope_idx=rng.randint(0, 1), span_idx=i, resource={"service.name": f"s{rs}"}, start_ns=start, end_ns=start + rng.randint(0, 9) * 10**9, status=rng.choice(["OK", "ERROR", "UNSET"]), attrs={"sampling.tail.threshold": rng.choice(["0x8", "0xf", "0x", "x"])} if rng.random() < 0.2 else {}))
    return out


BIG = Config(primary_cache_size=100_000, secondary_cache_size=50_000, sampled_cache_size=100_000, non_sampled_cache_size=100_000)
LISTS_OF_POLICIES = [
    [Named("t", Threshold()), Named("a", And((Probabilistic("", 50), StatusCode(("ERROR",))))), Named("r", RootSpans(Probabilistic("", 10))), Named("d", Downgrader("NotSampled", SpanCount(5))), Named("l", Latency(12_000))],
    [Named("l1", Downgrader("LowPriority", StatusCode(("ERROR",)))), Named("l2", Downgrader("LowPriority", SpanCount(2))), Named("l3", Downgrader("LowPriority", Latency(3000))), Named("n", SpanCount(6))],
]


def compare(spark, rows, named):
    exact = ExactSampler(BIG, named)
    for b in batches(rows):
        exact.consume(b)
    plan = Sampler(spark.createDataFrame(rows, SPAN), named)
    want = {k: "Sampled" for k in exact.sampled.keys()}
    want |= {k: "NotSampled" for k in exact.not_sampled.keys() if k not in want}
    got = {r.trace_id: r.decision for r in plan.decisions.collect()}
    assert {k: v for k, v in got.items() if v != "Pending"} == want
    ids = lambda payloads: sorted(s["span_id"] for p in payloads for s in p)
    assert sorted(r.span_id for r in plan.sampled.collect()) == ids(exact.emitted)
    assert {r.policy: r.n for r in plan.policy_decisions.groupBy("policy").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {p: sum(v for k, v in exact.metrics.items() if isinstance(k, tuple) and k[1] == p) for p in {k[1] for k in exact.metrics if isinstance(k, tuple) and k[1] != "evicted"}}
    assert plan.counters.first().traces_sampled == exact.metrics["traces_sampled"]
    _, held = exact.flush()
    flushed = plan.flushed.select("span_id", "resource_attrs").collect()
    assert sorted(r.span_id for r in flushed) == ids(held)
    assert all(r.resource_attrs[FLUSHES].i == 1 for r in flushed)


@pytest.mark.parametrize("named", LISTS_OF_POLICIES, ids=["window", "scan"])
@pytest.mark.parametrize("controls", [False, True])
def test_plan_equals_sequence(spark, named, controls):
    compare(spark, stream_of(random.Random(7), 40, 60, controls), named)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), which=st.integers(0, 1), controls=st.booleans())
def test_plan_equals_sequence_on_any_stream(spark, seed, which, controls):
    compare(spark, stream_of(random.Random(seed), 8, 12, controls), LISTS_OF_POLICIES[which])


def test_window_and_scan_agree(spark):
    rows = spark.createDataFrame(stream_of(random.Random(3), 30, 40), SPAN)
    named = flagship()
    evaluated = decide.evaluated(rows, named)
    cols = ["trace_id", "batch_seq", "rs_idx", "late", "decision", "policy", "position"]
    a, b = (sorted(map(tuple, f(evaluated, named).filter("not late").select(*cols).collect()), key=str) for f in (decide._by_window, decide._by_scan))
    assert a == b
    assert decide.remembers_low(with_low_priority()) and not decide.remembers_low(named)


def test_known_decisions_go_before_the_shuffle(spark):
    rows = spark.createDataFrame([span(T[0], "1"), span(T[1], "2"), span(T[2], "3", batch_seq=1), span(T[2], "4", rs_idx=1, resource={DECISION: True})], SPAN)
    known = spark.createDataFrame([(T[0], "Sampled"), (T[1], "NotSampled")], "trace_id string, decision string")
    s = Sampler(rows, [Named("none", Static("Pending"))], known)
    assert sorted(r.span_id for r in s.sampled.collect()) == ["1", "3"]
    assert [r.told for r in s.decisions.collect()] == [True]
    emitted, left = export.early_prune(rows, known)
    assert [r.span_id for r in emitted.collect()] == ["1"] and sorted(r.span_id for r in left.collect()) == ["3", "4"]


def test_placeholder(spark):
    named = [Named("no", Static("NotSampled"), emit_placeholder=True)]
    row = Sampler(spark.createDataFrame([span(T[0], "1")], SPAN), named).placeholders(5_000_000_000).first()
    assert (row.name, row.resource_attrs["service.name"].s, row.attrs["sampling.policy"].s, row.start_ns, row.end_ns, len(row.span_id)) == ("TRACE NOT SAMPLED", "not-sampled-dummy-service", "no", 4_000_000_000, 5_000_000_000, 16)
    assert Sampler(spark.createDataFrame([span(T[0], "1")], SPAN), [Named("no", Static("NotSampled"))]).placeholders(1).count() == 0


def test_no_policies_and_empty_input(spark):
    s = Sampler(spark.createDataFrame([span(T[0], "1")], SPAN), [])
    assert [r.decision for r in s.decisions.collect()] == ["Pending"] and s.sampled.count() == 0 and s.flushed.count() == 1
    empty = Sampler(spark.createDataFrame([], SPAN), flagship())
    assert empty.decisions.count() == empty.sampled.count() == empty.policy_decisions.count() == empty.decision_spans.count() == 0


def test_one_shuffle_by_trace(spark):
    """Window, decision and per-trace result share one exchange on the trace id; units have theirs."""
    rows = spark.createDataFrame([span(T[0], "1")], SPAN)
    plan = Sampler(rows, flagship(), zero_starts=False).decisions._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(trace_id") == 1 and plan.count("Exchange hashpartitioning(") == 2


def test_no_shuffle_for_the_scan(spark):
    """Low priority adds neither an exchange nor a sort to what the running totals need, and spans are gathered in no plan."""
    rows = spark.createDataFrame([span(T[0], "1")], SPAN)
    plans = [Sampler(rows, named).units._jdf.queryExecution().executedPlan().toString() for named in (flagship(), with_low_priority())]
    assert all(p.count("Exchange hashpartitioning(trace_id") == 1 and "collect_list" not in p for p in plans)
    assert "MapInArrow" in plans[1] and plans[0].count("Sort [") == plans[1].count("Sort [")


def test_long_traces_take_linear_time(spark):
    """One state goes along with a trace: its rows cost the same however many came before."""
    named, times = with_low_priority(), []
    for n in (20_000, 40_000):
        rows = spark.range(n).selectExpr(f"'{T[0]}' AS trace_id", "id AS batch_seq", "0 AS rs_idx", "CAST(NULL AS BOOLEAN) AS control", "id % 3 = 0 AS low", "CAST(1 AS BIGINT) AS cum_spans")
        rows = rows.selectExpr("*", "IF(low, 'LowPriority', 'Pending') AS _d0", "'Pending' AS _d1", "'Pending' AS _d2", "'Pending' AS _d3").coalesce(1)
        scan = decide._by_scan(rows, named)
        scan.write.format("noop").mode("overwrite").save()
        began = time.time()
        scan.write.format("noop").mode("overwrite").save()
        times.append(time.time() - began)
    assert times[1] < 2.2 * times[0] + 0.5


def evicting(rows, named, keep):
    """The sequence with unbounded caches, but that an undecided trace goes once more than ``keep`` batches passed without it."""
    exact, seen, out = ExactSampler(BIG, named), {}, {}
    last = max(r["batch_seq"] for r in rows)
    drop = lambda b: [k for k in exact.traces.keys() if b - seen[k] > keep]
    for payload in batches(rows):
        b = payload[0][0]["batch_seq"]
        for k in drop(b):
            exact.traces.delete(k)
        for resource in payload:
            exact.consume([resource])
        seen |= {s["trace_id"]: b for r in payload for s in r}
    for k in drop(last):
        exact.traces.delete(k)
    out |= {k: "NotSampled" for k in exact.not_sampled.keys()} | {k: "Sampled" for k in exact.sampled.keys()}
    return out, exact.metrics["traces_not_sampled"]


@pytest.mark.parametrize("named", LISTS_OF_POLICIES, ids=["window", "scan"])
def test_eviction_by_batches(spark, named):
    rows = stream_of(random.Random(5), 60, 80)
    want, count = evicting(rows, named, 6)
    plan = Sampler(spark.createDataFrame(rows, SPAN), named, keep_batches=6)
    got = plan.decisions.collect()
    assert {r.trace_id: r.decision for r in got if r.decision != "Pending"} == want and count > 0
    assert plan.counters.first().traces_not_sampled == count == sum(r.policy == "evicted" for r in got)
    assert all(r.age > 6 for r in metrics.eviction_ages(plan.units).collect())


def test_bad_spans_are_dropped_and_counted(spark):
    good = [span(T[0], "1"), span(T[1], "2", batch_seq=1)]
    bad = [span("", "3"), span("short", "4"), span(T[0].upper(), "5"), span(None, "6"), span(T[0], "7") | {"batch_seq": None}]
    s = Sampler(spark.createDataFrame(good + bad, SPAN), [Named("all", Static("Sampled"))])
    assert sorted(r.span_id for r in s.sampled.collect()) == ["1", "2"] and sorted(r.span_id for r in s.bad_spans.collect()) == ["3", "4", "5", "6", "7"]
    assert tuple(s.counters.first()) == (2, 0, 5)
    df, seen = metrics.observed(s.sampled)
    assert df.count() == 2 and seen.get["spans"] == 2 and seen.get["last_batch"] == 1


def test_lost_batches_are_logged(spark, caplog):
    def broken(batch, number):
        raise OSError("no such host")

    with caplog.at_level("ERROR"):
        forward(broken)(spark.range(1), 3)
    assert "batch 3" in caplog.text
