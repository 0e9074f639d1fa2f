from tracewinnow.model import NESTED, SPAN, span
from tracewinnow.operators.units import first_spans, services, units
from tracewinnow.sources import spans as S

T1, T2 = "1f" * 16, "a7" * 16


def rows():
    scope = {"name": "lib", "version": "1", "attrs": {}}
    return [span(T1, "a", scope_idx=0, span_idx=0, scope=scope, resource={"service.name": "x"}, links=[{"trace_id": T2, "span_id": "z", "attrs": {}}], events=[{"name": "e", "attrs": {"k": 1}}]), span(T2, "b", scope_idx=0, span_idx=1, scope=scope), span(T1, "c", scope_idx=1, span_idx=0, scope=scope), span(T1, "d", rs_idx=1, resource={"service.name": "y"})]


def test_nest_and_flatten(spark):
    df = spark.createDataFrame(rows(), SPAN)
    nested = S.nest(df).orderBy("trace_id", "rs_idx").collect()
    assert [(r.trace_id, r.rs_idx, [[s.span_id for s in ss.spans] for ss in r.resource_spans[0].scope_spans]) for r in nested] == [(T1, 0, [["a"], ["c"]]), (T1, 1, [["d"]]), (T2, 0, [["b"]])]
    first = nested[0].resource_spans[0]
    assert first.scope_spans[0].scope.name == "lib" and first.resource_attrs["service.name"].s == "x"
    assert first.scope_spans[0].spans[0].links[0].span_id == "z" and first.scope_spans[0].spans[0].events[0].attrs["k"].i == 1
    back = S.flatten(S.nest(df).select("batch_seq", "resource_spans"))
    assert sorted((r.trace_id, r.span_id) for r in back.collect()) == sorted((r["trace_id"], r["span_id"]) for r in rows())


def test_flatten_order_and_empty(spark):
    one = lambda i: {"trace_id": T1, "span_id": i, "parent_span_id": None, "name": "", "start_ns": 1, "end_ns": 1, "status": None, "attrs": {}, "events": [], "links": []}
    batch = {"batch_seq": 3, "resource_spans": [{"resource_attrs": {}, "scope_spans": []}, {"resource_attrs": {}, "scope_spans": [{"scope": None, "spans": []}, {"scope": None, "spans": [one("p"), one("q")]}]}, {"resource_attrs": {}, "scope_spans": [{"scope": None, "spans": [one("r")]}]}]}
    out = S.flatten(spark.createDataFrame([batch], NESTED)).orderBy("rs_idx", "scope_idx", "span_idx").collect()
    assert [(r.rs_idx, r.scope_idx, r.span_idx, r.span_id) for r in out] == [(1, 1, 0, "p"), (1, 1, 1, "q"), (2, 0, 0, "r")]
    assert all(r.parent_span_id == "0" * 16 and r.status == "UNSET" for r in out)


def test_files(spark, tmp_path):
    df = spark.createDataFrame(rows(), SPAN)
    for format in ("parquet", "orc", "json"):
        S.write(df, f"{tmp_path}/{format}", format, codec="none" if format == "json" else "zstd")
        assert sorted(r.span_id for r in S.read(spark, f"{tmp_path}/{format}", format).collect()) == ["a", "b", "c", "d"]


def test_units(spark):
    own = [span(T1, str(i), span_idx=i, start_ns=s, end_ns=9) for i, s in enumerate((5, 0, 7))]
    df = spark.createDataFrame(own, SPAN)
    assert [(r.n_spans, r.start_ns, r.end_ns) for r in units(df).collect()] == [(3, 7, 9)]
    assert [r.start_ns for r in units(df, zero_starts=False).collect()] == [0]
    df = spark.createDataFrame(rows(), SPAN)
    assert {(r.trace_id, r.rs_idx): r.span_id for r in first_spans(df).collect()} == {(T1, 0): "a", (T2, 0): "b", (T1, 1): "d"}
    assert {r.trace_id: r.services for r in services(df).collect()} == {T1: ["x", "y"], T2: []}
