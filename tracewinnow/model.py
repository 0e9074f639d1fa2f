"""The span schema and the closed domains of decisions and priorities."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T

#: Resource attributes that carry flush cycles and remembered decisions between
#: instances.  For exchange with another sampler set the prefix that it uses.
ATTRIBUTE_PREFIX = "tailsampling"
FLUSHES = f"{ATTRIBUTE_PREFIX}.flushes"
DECISION = f"{ATTRIBUTE_PREFIX}.decision"

#: Span attribute with a consistent-probability threshold.  Fixed value.
THRESHOLD = "sampling.tail.threshold"
#: The placeholder that stands for a trace that was not sampled.  Fixed values.
PLACEHOLDER_SERVICE, PLACEHOLDER_NAME, PLACEHOLDER_POLICY = "not-sampled-dummy-service", "TRACE NOT SAMPLED", "sampling.policy"

NO_PARENT = "0" * 16


class Decision(IntEnum):
    Unspecified = 0
    Pending = 1
    Sampled = 2
    NotSampled = 3
    LowPriority = 4

    @classmethod
    def parse(cls, name: str) -> Decision:
        try:
            return cls[name]
        except KeyError:
            raise ValueError(f"unknown decision {name!r}") from None


#: Decisions that end the evaluation of a unit's policies.
DECISIVE = ("Sampled", "NotSampled", "LowPriority")


class Priority(IntEnum):
    Low = 1
    Unspecified = 2

    @staticmethod
    def text(value: int) -> str:
        return Priority(value).name if value in (1, 2) else ""


#: An attribute value keeps its type: one field is set.
ATTR = T.StructType([T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType()), T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("j", T.StringType())])
ATTRS = T.MapType(T.StringType(), ATTR)
SCOPE = T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("attrs", ATTRS)])
EVENT = T.StructType([T.StructField("name", T.StringType()), T.StructField("attrs", ATTRS)])
LINK = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("span_id", T.StringType()), T.StructField("attrs", ATTRS)])

#: One row for each span; the first four columns are its place of arrival.
SPAN = T.StructType(
    [
        T.StructField("batch_seq", T.LongType()),
        T.StructField("rs_idx", T.IntegerType()),
        T.StructField("scope_idx", T.IntegerType()),
        T.StructField("span_idx", T.LongType()),
        T.StructField("resource_attrs", ATTRS),
        T.StructField("scope", SCOPE),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_ns", T.LongType()),
        T.StructField("end_ns", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("attrs", ATTRS),
        T.StructField("events", T.ArrayType(EVENT)),
        T.StructField("links", T.ArrayType(LINK)),
    ]
)

#: The same data as it arrives: batches of resources of scopes of spans.
_INNER = T.StructType([f for f in SPAN.fields if f.name not in ("batch_seq", "rs_idx", "scope_idx", "span_idx", "resource_attrs", "scope")])
NESTED = T.StructType(
    [
        T.StructField("batch_seq", T.LongType()),
        T.StructField(
            "resource_spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("resource_attrs", ATTRS),
                        T.StructField("scope_spans", T.ArrayType(T.StructType([T.StructField("scope", SCOPE), T.StructField("spans", T.ArrayType(_INNER))]))),
                    ]
                )
            ),
        ),
    ]
)


def attr(value) -> dict:
    """A Python value as an attribute."""
    out = dict.fromkeys("sbidj")
    if isinstance(value, bool):
        out["b"] = value
    elif isinstance(value, int):
        out["i"] = value
    elif isinstance(value, float):
        out["d"] = value
    elif isinstance(value, str):
        out["s"] = value
    else:
        import json

        out["j"] = json.dumps(value)
    return out


def span(trace_id: str, span_id: str = "", parent_span_id: str = NO_PARENT, *, batch_seq: int = 0, rs_idx: int = 0, scope_idx: int = 0, span_idx: int = 0, resource: dict | None = None, scope: dict | None = None, name: str = "", start_ns: int = 0, end_ns: int = 0, status: str = "UNSET", attrs: dict | None = None, events: list | None = None, links: list | None = None) -> dict:
    """A span row from plain Python values."""
    typed = lambda d: {k: attr(v) for k, v in (d or {}).items()}
    return {
        "batch_seq": batch_seq, "rs_idx": rs_idx, "scope_idx": scope_idx, "span_idx": span_idx, "resource_attrs": typed(resource), "scope": scope or {"name": "", "version": "", "attrs": {}}, "trace_id": trace_id, "span_id": span_id, "parent_span_id": parent_span_id,
        "name": name, "start_ns": start_ns, "end_ns": end_ns, "status": status, "attrs": typed(attrs), "events": [{"name": e.get("name", ""), "attrs": typed(e.get("attrs"))} for e in events or []], "links": links or [],
    }
