import random
from collections import Counter

from brute import words
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewinnow.llm import mixing as M


def test_targets():
    got = M.targets([("b", 100), ("a", 100), (None, 100), ("c", 100)])
    assert got["a"] == 200 and abs(sum(got.values()) - 600) < 1e-9
    # 600 tokens by 3, 1, 2, 3 over a, b, c, null: a and null stop at 200, the other 200 go by 1 and 2
    assert abs(got["b"] - 200 / 3) < 1e-9 and abs(got["c"] - 400 / 3) < 1e-9 and got[None] == 200
    assert M.targets([]) == {} and M.targets([("a", 0)]) == {"a": 0}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets_add_up(sizes):
    got = M.targets([(f"s{i:02}", n) for i, n in enumerate(sizes)])
    assert abs(sum(got.values()) - 1.5 * sum(sizes)) < 1e-6
    assert all(got[f"s{i:02}"] <= 2 * n + 1e-9 for i, n in enumerate(sizes))
    rates = {got[f"s{i:02}"] / (3, 1, 2)[i % 3] for i, n in enumerate(sizes) if got[f"s{i:02}"] < 2 * n - 1e-9}
    assert not rates or max(rates) - min(rates) < 1e-6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(1, 1000), st.floats(0.01, 0.99)), max_size=60), st.integers(0, 99))
def test_flight_keeps_both_totals(units, seed):
    done, left = M.flight(((i, x, p) for i, (x, p) in enumerate(units)), seed)
    assert len(left) <= 2 and len(done) + len(left) == len(units)
    tokens = sum(units[k][0] * s for k, s in done) + sum(x * p for _, x, p in left)
    documents = sum(s for _, s in done) + sum(p for *_, p in left)
    assert abs(tokens - sum(x * p for x, p in units)) < 1e-3 and abs(documents - sum(p for _, p in units)) < 1e-6


def test_flight_keeps_probabilities():
    """Over many seeds what the flight makes of a unit is its probability on average."""
    units = [(i, float(3 + i % 7), 0.3) for i in range(12)]
    hits = [0.0] * 12
    for seed in range(3000):
        done, left = M.flight(iter(units), seed)
        for k, s in [*done, *((k, p) for k, _, p in left)]:
            hits[k] += s
    assert all(abs(h / 3000 - 0.3) < 0.04 for h in hits)


def check(df, got, slack):
    rows = df.collect()
    sources = {}
    for r in rows:
        sources[r.source] = sources.get(r.source, 0) + len(words(r.text))
    target = M.targets(list(sources.items()))
    taken = dict.fromkeys(sources, 0)
    for g in got:
        assert g.source_size == sources[g.source] and abs(g.target - target[g.source]) < 1e-6
        assert 0 <= g.taken <= 2 * g.size and (not g.size or g.taken % g.size == 0)
        taken[g.source] += g.taken
    for s in sources:
        assert abs(taken[s] - target[s]) <= slack(s)


def test_balance(spark, small, odd):
    largest = lambda df: max(len(words(r.text)) for r in df.collect())
    for df in (small, odd):
        most = largest(df)
        check(df, M.mix(df).collect(), lambda s, most=most: most)
    r = random.Random(3)
    rows = [(i, "w " * r.randint(0, 60), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for group_rows, fan_in in ((2000, 256), (50, 3)):
        check(df, M.mix(df, group_rows=group_rows, fan_in=fan_in).collect(), lambda s: 60)


def test_reruns_and_partitions_agree(small):
    runs = [sorted(map(tuple, M.mix(small.repartition(n)).collect())) for n in (1, 5, 5)]
    assert runs[0] == runs[1] == runs[2]


def test_mixed(spark, small, odd, clashing, empty):
    """The rows taken are those of the mix, word for word, also where ids repeat with other texts or are missing."""
    more = spark.createDataFrame([(1, "a b c d e", "en", "src1", 1), (1, "x", "en", "src1", 1), (1, "y z", "en", "src2", 1), (None, "q r s", "en", "src1", 1), (None, "q r", "en", None, 1)] * 3, odd.schema)
    for df in (small, odd, odd.unionByName(more)):
        took = Counter()
        for r in M.mix(df).collect():
            took[r.doc_id, r.source, r.size] += r.copies
        out = M.mixed(df)
        assert out.columns == df.columns
        assert Counter((r.doc_id, r.source, len(words(r.text))) for r in out.collect()) == +took
    assert M.mixed(clashing).columns == clashing.columns and M.mixed(clashing).count() == M.mixed(odd).count()
    assert M.mixed(empty).count() == 0 and M.mixed(empty).columns == empty.columns


def test_contract(agree):
    agree(M.mix)
