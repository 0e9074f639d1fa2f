"""Span tables: flat and nested, read and written, in batch and as streams."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NESTED, NO_PARENT, SPAN

log = logging.getLogger(__name__)


def conform(df: DataFrame) -> DataFrame:
    """Any span table with the columns of ``SPAN``; missing ones are null, a missing parent is no parent."""
    have = set(df.columns)
    out = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SPAN.fields])
    return out.withColumns({"parent_span_id": F.when(F.coalesce("parent_span_id", F.lit("")) == "", F.lit(NO_PARENT)).otherwise(F.col("parent_span_id")), "status": F.coalesce("status", F.lit("UNSET"))})


#: What a span needs to be evaluated: a trace id of 16 bytes in hex, and its place of arrival.
USABLE = "coalesce(trace_id RLIKE '^[0-9a-f]{32}$', false) AND batch_seq IS NOT NULL AND rs_idx IS NOT NULL"


def split_bad(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans that can be evaluated, and those that are dropped and counted."""
    return spans.filter(USABLE), spans.filter(f"NOT ({USABLE})")


def forward(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that logs what goes wrong downstream and goes on: such spans are lost, not retried."""

    def sink(batch: DataFrame, number: int) -> None:
        try:
            write(batch, number)
        except Exception:  # noqa: BLE001 - whatever the sink raises
            log.exception("spans of batch %d could not be sent on and are lost", number)

    return sink


def flatten(batches: DataFrame) -> DataFrame:
    """Nested batches (``NESTED``) to spans, in order of resource, scope and span; empty resources and scopes give no rows."""
    rs = batches.select("batch_seq", F.posexplode("resource_spans").alias("rs_idx", "rs"))
    ss = rs.select("batch_seq", "rs_idx", "rs.resource_attrs", F.posexplode("rs.scope_spans").alias("scope_idx", "ss"))
    spans = ss.select("batch_seq", "rs_idx", "scope_idx", "resource_attrs", "ss.scope", F.posexplode("ss.spans").alias("span_idx", "span"))
    return conform(spans.select("batch_seq", "rs_idx", "scope_idx", "span_idx", "resource_attrs", "scope", "span.*"))


def nest(spans: DataFrame) -> DataFrame:
    """Spans to payloads, one for each trace under a resource of a batch: spans below their scope, scopes below the resource, order kept."""
    inner = [f.name for f in NESTED["resource_spans"].dataType.elementType["scope_spans"].dataType.elementType["spans"].dataType.elementType.fields]
    scopes = spans.groupBy("batch_seq", "rs_idx", "trace_id", "scope_idx").agg(F.first("resource_attrs").alias("resource_attrs"), F.first("scope").alias("scope"), F.array_sort(F.collect_list(F.struct("span_idx", F.struct(*inner).alias("span"))), _by("span_idx")).alias("own"))
    scopes = scopes.withColumn("ss", F.struct("scope", F.transform("own", lambda x: x["span"]).alias("spans")))
    payload = scopes.groupBy("batch_seq", "rs_idx", "trace_id").agg(F.first("resource_attrs").alias("resource_attrs"), F.array_sort(F.collect_list(F.struct("scope_idx", "ss")), _by("scope_idx")).alias("own"))
    resource = F.struct("resource_attrs", F.transform("own", lambda x: x["ss"]).alias("scope_spans"))
    return payload.select("batch_seq", "rs_idx", "trace_id", F.array(resource).alias("resource_spans"))


def _by(field: str):
    return lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)


def read(spark: SparkSession, path: str, format: str = "parquet", nested: bool = False) -> DataFrame:
    """Spans from files."""
    df = spark.read.format(format).schema(NESTED if nested else SPAN).load(path)
    return flatten(df) if nested else conform(df)


def read_stream(spark: SparkSession, path: str, format: str = "parquet", nested: bool = False, files_per_trigger: int = 1) -> DataFrame:
    """Spans from files as they arrive; admission is bounded by files for each trigger."""
    df = spark.readStream.format(format).schema(NESTED if nested else SPAN).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return flatten(df) if nested else conform(df)


def write(spans: DataFrame, path: str, format: str = "parquet", mode: str = "append", codec: str = "zstd") -> None:
    """Spans to files; ``codec`` stands in for compressing held payloads."""
    spans.write.format(format).mode(mode).option("compression", codec).save(path)
