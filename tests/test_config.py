import pytest

from tracewinnow.config import Config, ConfigError, Mapping_, PolicyConfig, RecordDecisionFrom, duration, from_dict, load
from tracewinnow.operators import policies as P

#: Every key that is known, each with a value of its own, and one policy of each type.
FULL = r"""
tail:
  policies:
    - {name: keep-slow, type: latency, latency: {threshold_ms: 750}}
    - {name: keep-consistent, type: threshold}
    - name: drop-chatty
      type: downgrader
      emit_single_span_for_not_sampled: true
      downgrader: {downgrade_to: NotSampled, sub_policy: {name: inner, type: span_count, span_count: {min_spans: 40, log_sampled: true}}}
    - name: keep-checkout-errors
      type: and
      record_decision_from: {res_attr_key: deployment, mappings: [{pattern: "^eu-", value: europe}, {pattern: "west$", value: west}]}
      and: {and_sub_policy: [{name: bad, type: status_code, status_code: {status_codes: [ERROR]}}, {name: some, type: probabilistic, probabilistic: {sampling_percentage: 62.5}}]}
    - {name: rate-from-outside, type: remote_probabilistic, remote_probabilistic: {rate_getter: dial, default_rate: 3.5, hash_salt: pepper}}
    - {name: lone-root, type: root_spans, root_spans: {sub_policy: {name: few, type: probabilistic, probabilistic: {sampling_percentage: 7, hash_salt: thyme}}}}
    - name: keep-cache-misses
      type: ottl_condition
      ottl_condition: {error_mode: propagate, spanevent: ['name == "miss"'], span: ['attributes["cache"] == "cold"', 'attributes["tenant"] != "internal"']}
  shards: 12
  flush_on_shutdown: true
  preprocess_buffer_size: 64
  compression_enabled: true
  target_heap_bytes: 7_500_000
  regulate_cache_delay: 90s
  secondary_cache_size: 33
  primary_cache_size: 255
  decision_cache: {non_sampled_cache_size: 81, sampled_cache_size: 27}
"""


def test_full_decode():
    c = load(FULL).validate()
    assert c.policies and {k: v for k, v in vars(c).items() if k != "policies"} == {
        "shards": 12, "flush_on_shutdown": True, "preprocess_buffer_size": 64, "compression_enabled": True, "target_heap_bytes": 7_500_000, "regulate_cache_delay_s": 90.0,
        "secondary_cache_size": 33, "primary_cache_size": 255, "non_sampled_cache_size": 81, "sampled_cache_size": 27,
    }
    assert c.initial_primary_size == 153
    named = {n.name: n for n in P.policies(c, {"dial": lambda: 11.0})}
    assert list(named) == [p.name for p in c.policies] and len({p.type for p in c.policies}) == 7
    assert named["keep-slow"].policy == P.Latency(750) and named["keep-consistent"].policy == P.Threshold()
    assert named["drop-chatty"].policy == P.Downgrader("NotSampled", P.SpanCount(40, True))
    assert [n for n in named if named[n].emit_placeholder] == ["drop-chatty"]
    errors = named["keep-checkout-errors"]
    assert errors.policy == P.And((P.StatusCode(("ERROR",)), P.Probabilistic("", 62.5)))
    assert (errors.record_from, errors.mappings) == ("deployment", (("^eu-", "europe"), ("west$", "west")))
    assert named["rate-from-outside"].policy.rate() == (11.0, False) and named["rate-from-outside"].policy.salts() == {"pepper"}
    assert named["lone-root"].policy == P.RootSpans(P.Probabilistic("thyme", 7))
    misses = named["keep-cache-misses"].policy
    assert (len(misses.span), len(misses.event), misses.error_mode) == (2, 1, "propagate")


def test_defaults():
    c = load("")
    assert c == Config() and c.validate() and (c.shards, c.primary_cache_size, c.secondary_cache_size, c.sampled_cache_size) == (1, 1000, 100, 10000)


@pytest.mark.parametrize("key, least", [("primary_cache_size", 2), ("secondary_cache_size", 1), ("shards", 1), ("preprocess_buffer_size", 0)])
def test_least_values(key, least):
    assert not Config(**{"secondary_cache_size": 1, key: least}).errors()
    assert len(Config(**{"secondary_cache_size": 1, key: least - 1}).errors()) == 1


@pytest.mark.parametrize("primary", [2, 3, 9, 64])
def test_secondary_is_at_most_half(primary):
    assert [bool(Config(primary_cache_size=primary, secondary_cache_size=n).errors()) for n in (primary // 2, primary // 2 + 1)] == [False, True]


def test_names_are_unique():
    names = lambda *n: Config(policies=tuple(PolicyConfig(x) for x in n)).errors()
    assert not names("slow", "Slow", "") and names("slow", "fast", "slow")


@pytest.mark.parametrize("key, pattern, ok", [("region", "^eu-(west|north)", True), ("region", "[a-f]{2}$", True), ("", "^eu", False), ("region", "", False), ("region", "(eu", False), ("region", "eu(?!-west)", False), ("region", r"(.)\1", False), ("region", "a++", False)])
def test_recorded_sources(key, pattern, ok):
    rule = RecordDecisionFrom(key, (Mapping_("plain", "x"), Mapping_(pattern, "y")))
    assert (Config(policies=(PolicyConfig("slow", record_decision_from=rule),)).errors() == []) == ok


def test_all_errors_are_reported():
    with pytest.raises(ConfigError) as e:
        Config(primary_cache_size=0, secondary_cache_size=0, shards=0, preprocess_buffer_size=-1).validate()
    assert len(e.value.errors) == 4


def test_unknown_and_nested_types():
    with pytest.raises(ConfigError):
        from_dict({"no_such_key": 1})
    for bad in (PolicyConfig("a", "nope"), PolicyConfig("a", "and", subs=(PolicyConfig("b", "and"),)), PolicyConfig("a", "downgrader", options={"downgrade_to": "NotSampled"}, subs=(PolicyConfig("b", "root_spans"),))):
        with pytest.raises(ConfigError):
            P.policies(Config(policies=(bad,)))
    with pytest.raises(ValueError):
        P.policies(Config(policies=(PolicyConfig("a", "downgrader", options={"downgrade_to": "Perhaps"}, subs=(PolicyConfig("b", "threshold"),)),)))
    with pytest.raises(ConfigError):
        P.policies(Config(policies=(PolicyConfig("a", "threshold"), PolicyConfig("a", "threshold"))))


def test_duration():
    assert [duration(x) for x in ("5m", "1h30m", "250ms", 0, "-2s")] == [300, 5400, 0.25, 0, -2]
    with pytest.raises(ConfigError):
        duration("5 parsecs")
