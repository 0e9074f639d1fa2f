"""DuckDB equivalents of the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

SIX_HOURS_MS = 6 * 3600 * 1000

SPANS = """
raw AS (SELECT *, epoch_us(ts) AS us, md5(user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS trace_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
spans AS (
  SELECT CAST(floor(event_id / 50.0) AS BIGINT) AS batch_seq, CAST(event_id % 4 AS INTEGER) AS rs_idx, CAST(event_id % 3 AS INTEGER) AS scope_idx, event_id AS span_idx, event_id % 3 * 1000000000 + event_id AS place, 'svc-' || (event_id % 4) AS service, trace_id,
    substr(md5('s' || event_id), 1, 16) AS span_id,
    CASE WHEN event_id = min(event_id) OVER (PARTITION BY trace_id) AND event_type <> 'click' THEN '0000000000000000'
         WHEN event_id % 7 = 0 THEN substr(trace_id, 17, 16) ELSE substr(md5('p' || trace_id), 1, 16) END AS parent_span_id,
    event_type AS name, us * 1000 AS start_ns, us * 1000 + CAST(floor(value * 1000000) AS BIGINT) AS end_ns,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'OK' ELSE 'UNSET' END AS status,
    CASE WHEN k < 10 THEN '0x' || format('{:02x}', 25 * k) WHEN k = 10 THEN 'invalid' WHEN k = 11 THEN '0x' END AS threshold
  FROM raw),
traces AS (SELECT DISTINCT trace_id FROM spans)"""


def hash64(salt: str) -> str:
    start = 0xCBF29CE484222325
    for b in salt.encode():
        start = (start ^ b) * 0x100000001B3 % (1 << 64)
    return _fold(start, 0x100000001B3, 1 << 64)


def _fold(start: int, prime: int, modulus: int) -> str:
    nibble = lambda i: f"(strpos('0123456789abcdef', substr(trace_id, {i}, 1)) - 1)"
    parts = ", ".join(f"CAST({nibble(2 * i + 1)} * 16 + {nibble(2 * i + 2)} AS HUGEINT)" for i in range(16))
    return f"list_reduce([CAST({start} AS HUGEINT), {parts}], lambda h, b: (xor(h, b) * {prime}) % {modulus})"


SHARD_START = 0x811C9DC5
for _b in b"s33d":
    SHARD_START = (SHARD_START ^ _b) * 0x01000193 % (1 << 32)


def number(text: str, digits: int) -> str:
    """Hex digits of an SQL string as a number."""
    return "(" + " + ".join(f"CAST(strpos('0123456789abcdef', substr({text}, {i + 1}, 1)) - 1 AS BIGINT) * {16 ** (digits - 1 - i)}" for i in range(digits)) + ")"


PARSED = f"CASE WHEN regexp_matches(threshold, '^0x[0-9a-fA-F]{{0,14}}$') THEN {number("rpad(lower(substr(threshold, 3)), 14, '0')", 14)} END"
RV = number("substr(trace_id, 19, 14)", 14)
ROOT = "(parent_span_id = '0000000000000000' OR parent_span_id = substr(trace_id, 17, 16))"
LIMIT_10, LIMIT_25, LIMIT_33, LIMIT_50 = 1844674407370955161, 4611686018427387903, 6087425544324152319, 9223372036854775807

UNITS = f"""{SPANS},
units AS (
  SELECT batch_seq, rs_idx, trace_id, count(*) AS n_spans, min(start_ns) AS start_ns, max(end_ns) AS end_ns, min({PARSED}) AS least, bool_or(status = 'ERROR') AS has_error, bool_or(status IN ('ERROR', 'OK')) AS has_status,
    arg_min({ROOT}, place) AS root, min(service) AS service,
    bool_or((span_idx % 5 = 0 AND span_idx // 5 % 3 = 2) OR (threshold = '0x' AND threshold IS NOT NULL) OR (name = 'error' AND NOT {ROOT}) OR (service = 'svc-3' AND threshold IS NOT NULL)) AS condition
  FROM spans GROUP BY batch_seq, rs_idx, trace_id),
running AS (
  SELECT *, sum(n_spans) OVER w AS cum_spans, min(start_ns) OVER w AS cum_start, max(end_ns) OVER w AS cum_end, {hash64('default-hash-seed')} AS hash
  FROM units WINDOW w AS (PARTITION BY trace_id ORDER BY batch_seq, rs_idx ROWS UNBOUNDED PRECEDING))"""

CONSISTENT = f"(least IS NOT NULL AND least < {(1 << 56) - 1} AND {RV} >= least)"
SLOW = f"(cum_end - cum_start) // 1000000 >= {SIX_HOURS_MS}"
LONE = f"(cum_spans = 1 AND root AND NOT hash <= {LIMIT_10})"

def decided(spans: str = SPANS, keep: int | None = None) -> str:
    """Decisions by unit and trace; with ``keep``, undecided traces are evicted after so many batches without a unit."""
    gone = f"coalesce(batch_seq - lag(batch_seq) OVER (PARTITION BY trace_id ORDER BY batch_seq, rs_idx) > {keep}, false)" if keep is not None else "false"
    end = f"CASE WHEN t.latest < (SELECT max(batch_seq) FROM spans) - {keep} THEN 'NotSampled' END" if keep is not None else "NULL"
    end_policy = f"CASE WHEN f.trace_id IS NULL AND t.latest < (SELECT max(batch_seq) FROM spans) - {keep} THEN 'evicted' END" if keep is not None else "NULL"
    return f"""{UNITS.replace(SPANS, spans)},
gaps AS (SELECT *, {gone} AS gone FROM running),
judged AS (
  SELECT *, CASE WHEN gone THEN 'NotSampled' WHEN {CONSISTENT} THEN 'Sampled' WHEN hash <= {LIMIT_50} AND has_error THEN 'Sampled' WHEN {LONE} THEN 'LowPriority' WHEN cum_spans >= 5 THEN 'NotSampled' WHEN {SLOW} THEN 'Sampled' ELSE 'Pending' END AS decision,
    CASE WHEN gone THEN 'evicted' WHEN {CONSISTENT} THEN 'consistent' WHEN hash <= {LIMIT_50} AND has_error THEN 'half-of-errors' WHEN {LONE} THEN 'lone-roots' WHEN cum_spans >= 5 THEN 'large' WHEN {SLOW} THEN 'slow' END AS policy
  FROM gaps),
marked AS (
  SELECT *, coalesce(bool_or(decision IN ('Sampled', 'NotSampled')) OVER (PARTITION BY trace_id ORDER BY batch_seq, rs_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM judged),
final AS (SELECT trace_id, decision, policy, batch_seq, rs_idx, service FROM marked WHERE NOT late AND decision IN ('Sampled', 'NotSampled')),
outcome AS (SELECT t.trace_id, coalesce(f.decision, {end}, 'Pending') AS decision, coalesce(f.policy, {end_policy}) AS policy, f.batch_seq, f.rs_idx FROM (SELECT trace_id, max(batch_seq) AS latest FROM units GROUP BY trace_id) t LEFT JOIN final f USING (trace_id))"""


DECIDED = decided()
#: Every 97th span has half a trace id and is dropped.
SOME_BAD = SPANS.replace("spans AS (", "every_span AS (").replace("traces AS (", "spans AS (SELECT * FROM every_span WHERE span_idx % 97 <> 0),\ntraces AS (")
KEPT = decided(SOME_BAD, 40)


def policy(condition: str, yes: str = "Sampled") -> str:
    return f"WITH {UNITS} SELECT batch_seq, rs_idx, trace_id, CASE WHEN {condition} THEN '{yes}' ELSE 'Pending' END AS decision FROM running"


KNOWN = "CASE WHEN trace_id < '4' THEN 'Sampled' WHEN trace_id < '6' THEN 'NotSampled' ELSE 'Unspecified' END"

LOW = f"""WITH RECURSIVE {UNITS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY batch_seq, rs_idx) AS rn, CASE WHEN cum_spans >= 4 THEN 'large' WHEN {SLOW} THEN 'slow' END AS sampled_by FROM running),
walk AS (
  SELECT trace_id, batch_seq, rs_idx, rn, CAST(NULL AS VARCHAR) AS before, CASE WHEN has_error THEN 'low-errors' WHEN cum_spans >= 2 THEN 'low-pairs' ELSE sampled_by END AS policy FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.trace_id, n.batch_seq, n.rs_idx, n.rn, CASE WHEN w.policy IN ('low-errors', 'low-pairs') THEN coalesce(w.before, w.policy) END,
    CASE WHEN n.has_error AND coalesce(CASE WHEN w.policy IN ('low-errors', 'low-pairs') THEN coalesce(w.before, w.policy) END, 'low-errors') = 'low-errors' THEN 'low-errors'
         WHEN n.cum_spans >= 2 AND coalesce(CASE WHEN w.policy IN ('low-errors', 'low-pairs') THEN coalesce(w.before, w.policy) END, 'low-pairs') = 'low-pairs' THEN 'low-pairs' ELSE n.sampled_by END
  FROM walk w JOIN numbered n ON n.trace_id = w.trace_id AND n.rn = w.rn + 1 WHERE w.policy IS NULL OR w.policy NOT IN ('large', 'slow')),
low AS (SELECT *, CASE WHEN policy IN ('low-errors', 'low-pairs') THEN 'LowPriority' WHEN policy IS NULL THEN 'Pending' ELSE 'Sampled' END AS decision FROM walk)"""

TOLD = f"""{DECIDED},
told AS (SELECT trace_id, 20 AS batch_seq, 9 AS rs_idx, CASE WHEN trace_id < 'c' THEN 'Sampled' ELSE 'NotSampled' END AS decision FROM traces WHERE trace_id >= 'a' AND trace_id < 'e'),
every AS (SELECT trace_id, batch_seq, rs_idx, decision, policy, false AS told FROM final UNION ALL SELECT trace_id, batch_seq, rs_idx, decision, NULL, true FROM told),
earliest AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY batch_seq, rs_idx) = 1)"""

BOUNDS = (500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000, 100_000_000, 1_000_000_000, 1_500_000_000, 3_000_000_000, 5_000_000_000)

ORACLE_SQL = {
    "hash_fnv64": f"WITH {SPANS} SELECT trace_id, format('{{:016x}}', CAST({hash64('default-hash-seed')} AS UBIGINT)) AS hash, format('{{:016x}}', CAST({hash64('sea-salt')} AS UBIGINT)) AS salted FROM traces",
    "shard_fnv32": f"WITH {SPANS} SELECT trace_id, CAST({_fold(SHARD_START, 0x01000193, 1 << 32)} % 5 AS INTEGER) AS shard FROM traces",
    "rv56": f"WITH {SPANS} SELECT trace_id, {RV} AS rv FROM traces",
    "threshold_parse": f"WITH {SPANS} SELECT span_id, threshold AS text, {PARSED} AS threshold FROM spans",
    "is_root": f"WITH {SPANS} SELECT span_id, {ROOT} AS is_root FROM spans",
    "duration_ms": f"WITH {SPANS} SELECT span_id, (end_ns - start_ns) // 1000000 AS ms, -((end_ns - start_ns) // 1000000) AS back_ms FROM spans",
    "first_span": f"WITH {SPANS} SELECT batch_seq, rs_idx, trace_id, arg_min(span_id, place) AS span_id, arg_min(parent_span_id, place) AS parent_span_id FROM spans GROUP BY batch_seq, rs_idx, trace_id",
    "services_per_unit": f"WITH {SPANS} SELECT batch_seq, trace_id, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM spans GROUP BY batch_seq, trace_id",
    "decision_grouping": f"WITH {SPANS} SELECT span_id, service, CASE WHEN regexp_matches(service, '^svc-[01]$') THEN 'low' WHEN regexp_matches(service, 'svc') THEN 'any' ELSE service END AS grouped FROM spans",
    "span_flatten": f"WITH {SPANS} SELECT batch_seq, trace_id, span_id, name, start_ns, dense_rank() OVER (PARTITION BY batch_seq, rs_idx, trace_id ORDER BY scope_idx) - 1 AS scope_idx, row_number() OVER (PARTITION BY batch_seq, rs_idx, trace_id, scope_idx ORDER BY span_idx) - 1 AS span_idx FROM spans",
    "nested_payloads": f"WITH {SPANS} SELECT trace_id, batch_seq, rs_idx, count(DISTINCT scope_idx) AS n_scopes, string_agg(span_id, ',' ORDER BY place) AS span_ids FROM spans GROUP BY trace_id, batch_seq, rs_idx",
    "unit_metadata": f"WITH {UNITS} SELECT batch_seq, rs_idx, trace_id, n_spans, start_ns, end_ns FROM units",
    "zero_starts": f"""WITH {SPANS}, altered AS (SELECT * REPLACE (CASE WHEN span_idx % 3 = 0 THEN 0 ELSE start_ns END AS start_ns, 0 AS rs_idx) FROM spans),
        seen AS (SELECT *, max(CASE WHEN start_ns = 0 THEN place END) OVER (PARTITION BY batch_seq, trace_id) AS zero FROM altered)
        SELECT batch_seq, rs_idx, trace_id, count(*) AS n_spans, coalesce(min(start_ns) FILTER (zero IS NULL OR place > zero), 0) AS start_ns, max(end_ns) AS end_ns FROM seen GROUP BY batch_seq, rs_idx, trace_id""",
    "running_metadata": f"WITH {UNITS} SELECT batch_seq, rs_idx, trace_id, CAST(cum_spans AS BIGINT) AS cum_spans, cum_start, cum_end FROM running",
    "policy_probabilistic": policy(f"hash <= {LIMIT_33}"),
    "policy_remote_probabilistic": policy(f"{hash64('sea-salt')} <= {LIMIT_25}"),
    "policy_span_count": policy("cum_spans >= 3"),
    "policy_latency": policy(SLOW),
    "policy_status_code": policy("has_status"),
    "policy_ottl": policy("condition"),
    "policy_threshold": policy(CONSISTENT),
    "policy_and": policy(f"hash <= {LIMIT_50} AND has_error"),
    "policy_root_spans": policy(LONE, "LowPriority"),
    "policy_downgrader": policy("cum_spans >= 3", "NotSampled"),
    "make_decision": f"WITH {DECIDED} SELECT batch_seq, rs_idx, trace_id, decision, policy, late FROM marked",
    "trace_decision": f"WITH {DECIDED} SELECT trace_id, decision, policy, batch_seq, rs_idx FROM outcome",
    "low_priority_state": f"{LOW} SELECT batch_seq, rs_idx, trace_id, decision, policy FROM low",
    "policy_decisions_metric": f"""WITH {DECIDED} SELECT policy, decision, CASE WHEN decision = 'LowPriority' THEN NULL WHEN policy = 'half-of-errors' THEN CASE WHEN service IN ('svc-0', 'svc-1') THEN 'svc-low' ELSE service END WHEN policy = 'large' THEN service ELSE '' END AS decision_from, count(*) AS n
        FROM marked WHERE NOT late AND decision <> 'Pending' GROUP BY 1, 2, 3""",
    "decision_lookup": f"WITH {SPANS} SELECT trace_id, {KNOWN} AS decision FROM traces",
    "early_prune": f"WITH {SPANS} SELECT span_id, CASE {KNOWN} WHEN 'Sampled' THEN 'emit' ELSE 'evaluate' END AS route FROM spans WHERE {KNOWN} <> 'NotSampled'",
    "late_spans": f"WITH {DECIDED} SELECT s.span_id, CASE o.decision WHEN 'Sampled' THEN 'emit' ELSE 'drop' END AS route FROM spans s JOIN outcome o USING (trace_id) WHERE o.decision <> 'Pending' AND (s.batch_seq > o.batch_seq OR (s.batch_seq = o.batch_seq AND s.rs_idx > o.rs_idx))",
    "sampled_export": f"""WITH {DECIDED} SELECT s.trace_id, s.span_id, s.start_ns, s.end_ns,
        CASE WHEN s.batch_seq = o.batch_seq AND s.rs_idx = o.rs_idx THEN 1 WHEN s.batch_seq < o.batch_seq OR (s.batch_seq = o.batch_seq AND s.rs_idx < o.rs_idx) THEN 0 ELSE 2 END AS emit_seq
        FROM spans s JOIN outcome o USING (trace_id) WHERE o.decision = 'Sampled'""",
    "placeholder_spans": f"WITH {DECIDED} SELECT trace_id, 'TRACE NOT SAMPLED' AS name, 1699999999000000000 AS start_ns, 1700000000000000000 AS end_ns, 'not-sampled-dummy-service' AS service, policy FROM final WHERE decision = 'NotSampled' AND policy = 'large'",
    "flush_pending": f"WITH {DECIDED} SELECT s.trace_id, s.span_id, CAST(1 AS BIGINT) AS flushes FROM spans s JOIN outcome o USING (trace_id) WHERE o.decision = 'Pending'",
    "flush_reingest": f"WITH {DECIDED}, sizes AS (SELECT trace_id, count(*) AS n FROM spans GROUP BY trace_id) SELECT s.trace_id, s.span_id, CASE WHEN z.n >= 2 THEN NULL ELSE CAST(2 AS BIGINT) END AS flushes FROM spans s JOIN outcome o USING (trace_id) JOIN sizes z USING (trace_id) WHERE o.decision = 'Pending'",
    "decision_spans": f"WITH {DECIDED} SELECT trace_id, 'decision' AS name, decision = 'Sampled' AS sampled, CASE decision WHEN 'Sampled' THEN 0 ELSE 1 END AS rs_idx FROM final",
    "decision_span_ingest": f"WITH {TOLD} SELECT t.trace_id, coalesce(e.decision, 'Pending') AS decision, e.policy, coalesce(e.told, false) AS told FROM traces t LEFT JOIN earliest e USING (trace_id)",
    "counters": f"WITH {KEPT} SELECT count(*) FILTER (decision = 'Sampled') AS traces_sampled, count(*) FILTER (policy = 'evicted') AS traces_not_sampled, (SELECT count(*) FROM every_span WHERE span_idx % 97 = 0) AS dropped_spans FROM outcome",
    "evicted_traces": f"WITH {KEPT} SELECT trace_id, decision, policy, batch_seq, rs_idx FROM outcome",
    "blocking_histogram": f"SELECT {' + '.join(f'CAST(ns > {b} AS INTEGER)' for b in BOUNDS)} AS bucket, count(*) AS n FROM (SELECT CAST(floor(value * 10000000) AS BIGINT) AS ns FROM events) WHERE ns IS NOT NULL GROUP BY 1",
    "gauge_last": f"WITH {KEPT}, first AS (SELECT trace_id, min(batch_seq) AS began FROM units GROUP BY trace_id) SELECT 'primary' AS cache, f.batch_seq - g.began AS age FROM final f JOIN first g USING (trace_id) WHERE f.policy = 'evicted' ORDER BY f.batch_seq DESC, f.trace_id DESC LIMIT 1",
    "regulator_steps": """SELECT event_id, CAST(greatest(500, least(1000, CASE WHEN heap / 10000.0::DOUBLE > 1.3 THEN 500 WHEN heap / 10000.0::DOUBLE > 1.15 THEN floor(size * (10000.0::DOUBLE / heap) * (10000.0::DOUBLE / heap))
        WHEN heap / 10000.0::DOUBLE > 1.0 THEN floor(size * 10000.0::DOUBLE / heap) WHEN heap / 10000.0::DOUBLE < 0.85 THEN floor(size * 1.02::DOUBLE) ELSE size END)) AS BIGINT) AS new_size
        FROM (SELECT event_id, CAST(event_id % 501 + 500 AS DOUBLE) AS size, CAST(floor(value * 100) + 8000 AS DOUBLE) AS heap FROM events)""",
    "cache_tier": f"{LOW} SELECT trace_id, CASE WHEN bool_and(decision = 'LowPriority') THEN 'secondary' ELSE 'primary' END AS tier FROM low GROUP BY trace_id HAVING NOT bool_or(decision = 'Sampled')",
    "stream_decisions": f"WITH {DECIDED} SELECT trace_id, decision, policy FROM final",
    "stream_export": f"""WITH {DECIDED} SELECT s.trace_id, s.span_id, s.name, CASE WHEN s.batch_seq = o.batch_seq AND s.rs_idx = o.rs_idx THEN 1 WHEN s.batch_seq < o.batch_seq OR (s.batch_seq = o.batch_seq AND s.rs_idx < o.rs_idx) THEN 0 ELSE 2 END AS emit_seq
        FROM spans s JOIN outcome o USING (trace_id) WHERE o.decision = 'Sampled'
        UNION ALL SELECT trace_id, NULL, 'TRACE NOT SAMPLED', NULL FROM final WHERE decision = 'NotSampled' AND policy = 'large'""",
    "stream_flush": f"""WITH {DECIDED} SELECT s.trace_id, s.span_id, s.name, CAST(1 AS BIGINT) AS flushes, CAST(NULL AS BOOLEAN) AS sampled FROM spans s JOIN outcome o USING (trace_id) WHERE o.decision = 'Pending'
        UNION ALL SELECT trace_id, NULL, 'decision', NULL, decision = 'Sampled' FROM final""",
}
