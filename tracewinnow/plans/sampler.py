"""The whole sampler as one plan over a span table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import decide, export, metrics
from ..operators.policies import Named, policies
from ..sources.spans import split_bad
from ..sources.tables import stored


@dataclass
class Sampler:
    """Policies over spans.  Results are lazy tables; ``units`` and ``decisions`` are shared by the others.

    ``known``: decisions from before (trace_id, decision).  Their traces are
    released or dropped before the shuffle.  ``zero_starts``: whether a span may
    start at 0, if that is known.  ``keep_batches``: how many batches a trace may
    stay undecided without a new span; unbounded if not given.
    """

    spans: DataFrame
    named: list[Named]
    known: DataFrame | None = None
    zero_starts: bool | None = None
    keep_batches: int | None = None

    @classmethod
    def of(cls, spans: DataFrame, config: Config, getters: Mapping[str, Any] | None = None, **options) -> Sampler:
        return cls(spans, policies(config.validate(), getters or {}), **options)

    @cached_property
    def _usable(self) -> tuple[DataFrame, DataFrame]:
        return split_bad(self.spans)

    @cached_property
    def _parts(self) -> tuple[DataFrame | None, DataFrame]:
        return (None, self._usable[0]) if self.known is None else export.early_prune(self._usable[0], self.known)

    @cached_property
    def units(self) -> DataFrame:
        return decide.unit_decisions(self._parts[1], self.named, self.zero_starts, self.keep_batches)

    @cached_property
    def decisions(self) -> DataFrame:
        last_kept = None
        if self.keep_batches is not None:
            last = self.spans.agg(F.max("batch_seq")).first()[0]  # one number
            last_kept = None if last is None else last - self.keep_batches
        return decide.trace_decisions(self.units, last_kept)

    def stored(self, units: bool = False) -> Sampler:
        """The same sampler with its decisions, or its units, written once for all that reads them."""
        if units:
            self.units = stored(self.units, "units")
        else:
            self.decisions = stored(self.decisions, "decisions")
        return self

    @cached_property
    def bad_spans(self) -> DataFrame:
        return self._usable[1]

    @cached_property
    def sampled(self) -> DataFrame:
        """Released spans; those of traces known before have no ``emit_seq``."""
        out = export.sampled_spans(self._parts[1], self.decisions)
        return out if self._parts[0] is None else out.unionByName(self._parts[0], allowMissingColumns=True)

    def placeholders(self, now_ns: int) -> DataFrame:
        return export.placeholders(self.decisions, self.named, now_ns)

    @cached_property
    def flushed(self) -> DataFrame:
        return export.flushed_spans(self._parts[1], self.decisions)

    @cached_property
    def decision_spans(self) -> DataFrame:
        return export.decision_spans(self.decisions)

    @cached_property
    def policy_decisions(self) -> DataFrame:
        return metrics.policy_decisions(self.units, self.named)

    @cached_property
    def counters(self) -> DataFrame:
        return metrics.counters(self.decisions, self.bad_spans)
