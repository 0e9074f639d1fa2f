"""The sampler over a stream of spans, keyed by trace.

Traces are dealt to buckets by hash, and within a bucket to cells; a bucket's
state has two entries for each cell, its undecided traces and its decisions, of
which a trigger touches those that it has rows of.  State per trace: its totals,
its held spans and its decision.  Capacity is bounded by time instead of by
count: a trace that stays undecided for
``primary_ttl_ms`` (``secondary_ttl_ms`` while it is low priority) is evicted as
not sampled, and a decision is forgotten after ``decision_ttl_ms``.

Within a micro-batch a trace's rows are sorted by place of arrival and
evaluated unit by unit, so results don't depend on where triggers fall.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..model import DECISION, SPAN
from ..operators import export
from ..operators.exact import Trace, decide
from ..operators.policies import Named, Unit
from ..sources.spans import USABLE

#: kind: span (released), decision (of a trace), placeholder (for one that a policy did not sample).
#: emit_seq: of a span, 0 what was held when the decision fell, 1 the unit that made it, 2 what came later.
OUTPUT = "trace_id string, kind string, decision string, policy string, batch_seq long, rs_idx int, emit_seq int, span string"


#: Traces share a group of state by hash, so that a trigger calls Python once for a group and not for each trace.
BUCKETS = 4096
#: Undecided traces and decisions of a bucket are each stored together in so many entries, as JSON.
SLOTS = 64
#: A trace has so many held spans beside its totals at most; more go to entries of their own, which are not written again.
INLINE = 16
#: Where an entry of undecided traces gets longer, held spans of those that a trigger touches go to entries of their own too.
CELL_CHARS = 65_536
#: Rows of output that are gathered at most before they are passed on, but for one trace's.
OUT_ROWS = 5000
PLACE = ("batch_seq", "rs_idx", "scope_idx", "span_idx")
_place = itemgetter(*PLACE)
_parsed = json.JSONDecoder().raw_decode
COLUMNS = ["trace_id", "kind", "decision", "policy", "batch_seq", "rs_idx", "emit_seq", "span"]


@dataclass
class Held:
    """What is known of an undecided trace, with its spans but for those in ``parts`` other entries."""

    span_count: int
    earliest: int
    latest: int
    low: bool
    last_low: str | None
    due: int | None = None
    parts: int = 0
    spans: list[str] = field(default_factory=list)


class TraceState(StatefulProcessor):
    """Traces of a bucket.  Undecided traces share entries, decisions share others; each is read and written at most once a trigger."""

    def __init__(self, named: list[Named], primary_ttl_ms: int, secondary_ttl_ms: int, decision_ttl_ms: int, bounded: bool):
        self.named = named
        self.ttl = {"primary": primary_ttl_ms, "secondary": secondary_ttl_ms}
        self.decision_ttl = decision_ttl_ms
        self.bounded = bounded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getMapState("totals", "slot int", "traces string")
        self.held = handle.getMapState("held", "trace_id string, part int", "spans array<string>")
        #: an entry goes when its last decision is forgotten; until then each decision's own time counts
        self.decision = handle.getMapState("decision", "slot int", "decisions string", None if self.bounded else self.decision_ttl)
        #: traces by the time at which they are to be evicted, if that is still what their totals say
        self.due = handle.getMapState("due", "due long", "trace_ids array<string>, slots array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots: dict[int, dict[str, list[str]]] = {}
        for pdf in rows:
            for slot, trace_id, text in zip(pdf["slot"].tolist(), pdf["trace_id"].tolist(), pdf["span"].tolist()):
                slots.setdefault(slot, {}).setdefault(trace_id, []).append(text)
        decided, undecided = self.decision.exists(), self.totals.exists()
        now = 0 if self.bounded else timerValues.getCurrentProcessingTimeInMs()
        due: dict[int, list[tuple[str, int]]] = {}
        out: list[tuple] = []
        for slot, own in slots.items():
            known = self._decisions(slot, now) if decided else {}
            cell = self._cell(slot) if undecided else {}
            n_known, n_cell = len(known), len(cell)
            kept: dict[str, Held] = {}
            for trace_id, texts in own.items():
                held = Held(**cell.pop(trace_id)) if trace_id in cell else None
                decision, held = self.trace(trace_id, texts, known[trace_id][0] if trace_id in known else None, held, out)
                if held is not None:
                    kept[trace_id] = held
                elif trace_id not in known:
                    known[trace_id] = (decision, self._until(now))
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=COLUMNS, dtype=object)
                    out = []
            if kept or len(cell) < n_cell:
                self._keep(slot, cell, kept, now, due)
            if len(known) > n_known:
                self._decide(slot, known)
        for at, ids in due.items():
            old = self.due.getValue((at,)) or ([], [])
            self.due.updateValue((at,), ([*old[0], *(i for i, _ in ids)], [*old[1], *(s for _, s in ids)]))
            self.handle.registerTimer(at)
        yield pd.DataFrame(out, columns=COLUMNS, dtype=object)

    def trace(self, trace_id: str, texts: list[str], known: str | None, held: Held | None, out: list[tuple]) -> tuple[str | None, Held | None]:
        """All rows of a trace in this trigger."""
        spans = [_parsed(t)[0] for t in texts]
        places = [_place(s) for s in spans]
        for at, group in groupby(sorted(range(len(spans)), key=places.__getitem__), key=lambda i: places[i][:2]):
            group = list(group)
            known, held = self.unit(trace_id, at, [spans[k] for k in group], [texts[k] for k in group], known, held, out)
        return known, held

    def _until(self, now: int) -> int | None:
        return None if self.bounded else now + self.decision_ttl

    def _decisions(self, slot: int, now: int) -> dict[str, tuple[str, int | None]]:
        """Decisions that are remembered, and when they are forgotten."""
        found = self.decision.getValue((slot,))
        return {k: (d, at) for k, (d, at) in json.loads(found[0]).items() if at is None or at > now} if found else {}

    def _decide(self, slot: int, known: dict[str, tuple[str, int | None]]) -> None:
        self.decision.updateValue((slot,), (json.dumps(known),))

    def _cell(self, slot: int) -> dict[str, dict]:
        """Undecided traces, each the fields of what is held of it."""
        found = self.totals.getValue((slot,))
        return json.loads(found[0]) if found else {}

    def _keep(self, slot: int, cell: dict[str, dict], kept: dict[str, Held], now: int, due: dict[int, list[tuple[str, int]]]) -> None:
        """Undecided traces of a cell: those not touched, and those that were."""
        for trace_id, held in kept.items():
            if len(held.spans) > INLINE:
                self._part(trace_id, held)
            if not self.bounded:
                held.due = now + self.ttl["secondary" if held.low else "primary"]
                due.setdefault(held.due, []).append((trace_id, slot))
        text = self._text(cell, kept)
        if len(text) > CELL_CHARS:
            for trace_id, held in kept.items():
                if held.spans:
                    self._part(trace_id, held)
            text = self._text(cell, kept)
        if cell or kept:
            self.totals.updateValue((slot,), (text,))
        else:
            self.totals.removeKey((slot,))

    @staticmethod
    def _text(cell: dict[str, dict], kept: dict[str, Held]) -> str:
        return json.dumps(cell | {k: vars(h) for k, h in kept.items()}, ensure_ascii=False)

    def _part(self, trace_id: str, held: Held) -> None:
        """A trace's held spans go to an entry of their own."""
        self.held.updateValue((trace_id, held.parts), (held.spans,))
        held.parts, held.spans = held.parts + 1, []

    def unit(self, trace_id: str, at: tuple, spans: list[dict], texts: list[str], known: str | None, held: Held | None, out: list[tuple]) -> tuple[str | None, Held | None]:
        """The trace's decision and what is held of it after a unit."""
        told = (spans[0].get("resource_attrs") or {}).get(DECISION)
        if known is not None:
            if known == "Sampled" and told is None:
                self.send(trace_id, at, 2, texts, out)
            return known, None
        if told is not None:
            return self.finish(trace_id, at, "Sampled" if told.get("b") else "NotSampled", None, [], held, out)
        for s in spans:
            s["attrs"], s["events"] = s.get("attrs") or {}, s.get("events") or []
            s["parent_span_id"] = s.get("parent_span_id")
        new = Trace.of(spans)
        count, start, end, low, last_low = new.span_count, new.earliest_start, new.latest_end, None, None
        if held is not None:
            count, start, end, low, last_low = count + held.span_count, min(start, held.earliest), max(end, held.latest), held.low, held.last_low
        got = decide(Unit(trace_id, spans, count, start, end, last_low), self.named, spans[0].get("resource_attrs"))
        if got.decision in ("Sampled", "NotSampled"):
            after = self.finish(trace_id, at, got.decision, got.policy.name, texts, held, out)
            if got.decision == "NotSampled" and got.policy.emit_placeholder:
                out.append((trace_id, "placeholder", got.decision, got.policy.name, *at, None, None))
            return after
        is_low = got.decision == "LowPriority"
        name = (last_low or got.policy.name) if is_low else None
        held = held or Held(0, 0, 0, False, None)
        held.span_count, held.earliest, held.latest, held.low, held.last_low = count, start, end, is_low and low is not False, name
        held.spans += texts
        return None, held

    @staticmethod
    def send(trace_id: str, at: tuple, seq: int, texts: list[str], out: list[tuple]) -> None:
        out.extend((trace_id, "span", None, None, *at, seq, t) for t in texts)

    def finish(self, trace_id: str, at: tuple, decision: str, policy: str | None, texts: list[str], held: Held | None, out: list[tuple]) -> tuple[str, None]:
        """A decision falls: held spans are released or dropped.  Who calls stores the decision and what is left of the cell."""
        if held is not None:
            for part in range(held.parts):
                if decision == "Sampled":
                    self.send(trace_id, at, 0, self.held.getValue((trace_id, part))[0], out)
                self.held.removeKey((trace_id, part))
            if decision == "Sampled":
                self.send(trace_id, at, 0, held.spans, out)
        if decision == "Sampled":
            self.send(trace_id, at, 1, texts, out)
        out.append((trace_id, "decision", decision, policy, *at, None, None))
        return decision, None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        now = timerValues.getCurrentProcessingTimeInMs()
        out: list[tuple] = []
        slots: dict[int, list[str]] = {}
        for trace_id, slot in dict.fromkeys(zip(*(self.due.getValue((at,)) or ([], [])))):
            slots.setdefault(slot, []).append(trace_id)
        for slot, ids in slots.items():
            cell = self._cell(slot)
            gone = [i for i in ids if i in cell and cell[i]["due"] == at]
            if not gone:
                continue
            for trace_id in gone:
                self.finish(trace_id, (None, None), "NotSampled", "evicted", [], Held(**cell.pop(trace_id)), out)
            self._keep(slot, cell, {}, now, {})
            self._decide(slot, self._decisions(slot, now) | {i: ("NotSampled", self._until(now)) for i in gone})
        self.due.removeKey((at,))
        yield pd.DataFrame(out, columns=COLUMNS, dtype=object)

    def close(self) -> None:
        pass


#: The state store that keyed state of this kind needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def sample_stream(spans: DataFrame, named: list[Named], primary_ttl_ms: int = 600_000, secondary_ttl_ms: int = 60_000, decision_ttl_ms: int = 3_600_000, bounded: bool = False) -> DataFrame:
    """Released spans, decisions and placeholders of a stream of spans; spans are JSON in ``span``.

    Spans that can't be evaluated are dropped.  ``bounded``: the input ends (a
    replay of files); nothing is evicted, and a query that runs until all is
    read comes to an end.  The session gets the state store that this needs.
    """
    spans.sparkSession.conf.set(*STATE_STORE)
    cell = F.pmod(F.xxhash64("trace_id"), F.lit(BUCKETS * SLOTS))
    packed = spans.filter(USABLE).select((cell % BUCKETS).cast("int").alias("bucket"), F.floor(cell / BUCKETS).cast("int").alias("slot"), "trace_id", F.to_json(F.struct(*spans.columns)).alias("span"))
    return packed.groupBy("bucket").transformWithStateInPandas(TraceState(named, primary_ttl_ms, secondary_ttl_ms, decision_ttl_ms, bounded), OUTPUT, "Append", "None" if bounded else "ProcessingTime")


def spans_of(output: DataFrame) -> DataFrame:
    """The released spans of a stream's output, as they go downstream: with ``emit_seq``, without flush counts."""
    rows = output.filter("kind = 'span'").select(F.from_json("span", SPAN).alias("span"), "emit_seq").select("span.*", "emit_seq")
    return export.without_flushes(rows)


def placeholders_of(output: DataFrame, now_ns: int) -> DataFrame:
    """The placeholders of a stream's output as spans."""
    rows = output.filter("kind = 'placeholder'")
    return export.placeholder_spans(rows, now_ns)


def blocking_times(spark: SparkSession, progress: list) -> DataFrame:
    """How long each trigger of a query held its spans back before they were evaluated, in nanoseconds; ``progress`` is its ``recentProgress``.

    Feeds :func:`tracewinnow.operators.metrics.histogram`.
    """
    before = ("latestOffset", "getOffset", "getBatch", "queryPlanning", "walCommit")
    waits = [(p["batchId"], 1_000_000 * sum(p["durationMs"].get(k, 0) for k in before)) for p in progress if p["numInputRows"]]
    return spark.createDataFrame(waits, "batch_id long, ns long")


def flush_state(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """What a stopped stream left in its state: held spans, their flush count raised by 1, and decisions as spans.

    ``checkpoint`` is the query's ``checkpointLocation``.  The state is read as
    of its last batch and is not changed.
    """
    def entries(name: str) -> DataFrame:
        rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).option("flattenCollectionTypes", True).load()
        lasting = "ttlExpirationMs" not in rows.schema["user_map_value"].dataType.names
        return rows.select("user_map_value.*" if lasting else "user_map_value.value.*")

    cells = entries("totals").select(F.explode(F.from_json("traces", "map<string, struct<spans: array<string>>>")))
    texts = entries("held").select("spans").unionByName(cells.select("value.spans"))
    held = texts.select(F.explode("spans").alias("span")).select(F.from_json("span", SPAN).alias("span")).select("span.*")
    triggers = spark.read.text(f"{checkpoint}/offsets").select(F.get_json_object("value", "$.batchTimestampMs").cast("long").alias("at"))
    last = triggers.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]  # one number
    decisions = entries("decision").select(F.explode(F.from_json("decisions", "map<string, array<string>>")).alias("trace_id", "told"))
    decisions = decisions.select("trace_id", F.col("told")[0].alias("decision"), F.col("told")[1].cast("long").alias("forgotten"))
    decisions = decisions.filter(F.col("forgotten").isNull() | (F.col("forgotten") > last)).drop("forgotten")
    return export.raised(held), export.decision_spans(decisions)
