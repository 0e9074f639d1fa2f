"""The provided ``events`` table as spans: a user's day is a trace, an event a span.

Spans are dealt to four resources and three scopes by their event's number; some
carry span events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import ATTR, ATTRS, EVENT, LINK, NO_PARENT, SCOPE, SPAN, THRESHOLD


def attribute(field: str, value: str) -> str:
    """An attribute with one field set, in SQL."""
    return "named_struct(" + ", ".join(f"'{f.name}', CAST({value if f.name == field else 'NULL'} AS {f.dataType.simpleString()})" for f in ATTR.fields) + ")"


def events_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In SQL text, as building it column by column takes longer than the small tables do."""
    none = f"CAST(map() AS {ATTRS.simpleString()})"
    retry = f"named_struct('name', 'retry', 'attrs', map('attempt', {attribute('i', 'event_id div 5 % 3')}))"
    note = f"named_struct('name', 'note', 'attrs', {none})"
    threshold = "CASE WHEN k < 10 THEN concat('0x', lower(lpad(hex(25 * k), 2, '0'))) WHEN k = 10 THEN 'invalid' WHEN k = 11 THEN '0x' END"
    columns = {
        "batch_seq": "CAST(floor(event_id / 50.0) AS BIGINT)",
        "rs_idx": "CAST(event_id % 4 AS INT)",
        "scope_idx": "CAST(event_id % 3 AS INT)",
        "span_idx": "event_id",
        "resource_attrs": f"map('service.name', {attribute('s', 'concat(\'svc-\', CAST(event_id % 4 AS STRING))')})",
        "scope": f"CAST(NULL AS {SCOPE.simpleString()})",
        "trace_id": "trace_id",
        "span_id": "substring(md5(concat('s', CAST(event_id AS STRING))), 1, 16)",
        "parent_span_id": f"CASE WHEN first AND event_type <> 'click' THEN '{NO_PARENT}' WHEN event_id % 7 = 0 THEN substring(trace_id, 17, 16) ELSE substring(md5(concat('p', trace_id)), 1, 16) END",
        "name": "event_type",
        "start_ns": "us * 1000",
        "end_ns": "us * 1000 + long_ns",
        "status": "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'OK' ELSE 'UNSET' END",
        "attrs": f"CASE WHEN k < 12 THEN map('{THRESHOLD}', {attribute('s', threshold)}) ELSE {none} END",
        "events": f"CASE WHEN event_id % 10 = 0 THEN array({retry}, {note}) WHEN event_id % 5 = 0 THEN array({retry}) ELSE CAST(array() AS ARRAY<{EVENT.simpleString()}>) END",
        "links": f"CAST(NULL AS ARRAY<{LINK.simpleString()}>)",
    }
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.selectExpr(
        "CAST(event_id AS BIGINT) AS event_id",
        "event_type",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS us",
        "CAST(floor(value * 1000000) AS BIGINT) AS long_ns",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "md5(concat_ws('|', CAST(user_id AS STRING), CAST(to_date(ts) AS STRING))) AS trace_id",
    )
    rows = rows.selectExpr("*", "min(event_id) OVER (PARTITION BY trace_id) = event_id AS first")
    return rows.selectExpr(*[f"{columns[f.name]} AS {f.name}" for f in SPAN.fields])
