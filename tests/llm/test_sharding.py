from collections import defaultdict

from brute import crc
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewinnow.llm import sharding as S


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=14), st.integers(1, 5))
def test_smallest_capacity(sizes, shards):
    """No contiguous split of the order into so many parts has a smaller largest part."""
    sizes = sorted(sizes, reverse=True)
    runs = S.Runs([(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)])
    cuts = S.minimax_cuts(runs, shards)
    assert cuts == sorted(set(cuts)) and len(cuts) < shards and all(0 < c < len(sizes) for c in cuts)
    got = max(sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)]))

    def best(i, left):
        if left == 1:
            return sum(sizes[i:])
        return min(max(sum(sizes[i:j]), best(j, left - 1)) for j in range(i, len(sizes) + 1))

    assert got == best(0, shards)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=40), st.integers(1, 6), st.integers(0, 12))
def test_classes_of_sizes(sizes, shards, below):
    """Cuts from sums by classes, with single classes fetched, are those of the whole summary."""
    runs = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
    own = lambda s: s >> below << below
    names = sorted({own(s) for s in sizes}, reverse=True)
    classes = S.Classes([(c, sum(n for s, n in runs if own(s) == c), sum(s * n for s, n in runs if own(s) == c)) for c in names], lambda c: [(s, n) for s, n in runs if own(s) == c])
    plain = S.Runs(runs)
    cuts = S.minimax_cuts(plain, shards)
    assert S.minimax_cuts(classes, shards) == cuts and [classes.place(c) for c in cuts] == [plain.place(c) for c in cuts]


def test_large_summaries(spark, small):
    """A summary that the driver doesn't take whole gives the same shards."""
    assert sorted(map(tuple, S.shard(small, most_sizes=3).collect()), key=str) == sorted(map(tuple, S.shard(small).collect()), key=str)
    rows = spark.createDataFrame([(1,), (4095,), (4096,), (4097,), (8191,), (8193,), (10**9 + 7,)], "s long")
    assert [r[0] for r in rows.select(S.class_of(rows.s)).collect()] == [s >> max(0, s.bit_length() - 1 - S.CLASS_BITS) << max(0, s.bit_length() - 1 - S.CLASS_BITS) for (s,) in rows.collect()]


def check(rows, got):
    by_shard, by_text = defaultdict(list), defaultdict(set)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r[0] is None, r[0] or 0, size(r[1]), crc(r[1])) for r in rows) == sorted((g.doc_id is None, g.doc_id or 0, g.size, g.text_crc32) for g in got)
    for g in got:
        assert g.law == "bytes" and 0 <= g.shard < 16 and g.grown_shard is None
        by_shard[g.shard].append(g)
        by_text[g.size, g.text_crc32].add(g.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(g.slot for g in own) == list(range(len(own))) for own in by_shard.values())
    return {k: sum(g.size for g in v) for k, v in by_shard.items()}


def test_against_definition(odd, odd_rows, small, spark):
    check(odd_rows, S.shard(odd).collect())
    loads = check([(r.doc_id, r.text) for r in small.collect()], S.shard(small).collect())
    assert len(loads) == 16
    rows = [(i, f"{i:05d}" * (1 + i % 3)) for i in range(3000)]
    loads = check(rows, S.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), buckets=4).collect())
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= 16 * 16


def test_hot_group(spark):
    """A group larger than an even share has a shard of its own; the rest is even."""
    rows = [(i, "hot" * 10 if i % 3 == 0 else f"{i:030d}") for i in range(3000)]
    loads = check(rows, S.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    rest = sorted(loads.values())[:-1]
    assert max(loads.values()) == 31_000 and len(rest) == 15 and rest[-1] - rest[0] <= 31 * 15


def test_contract(agree):
    agree(S.shard)


def test_native(odd):
    plan = S.shard(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
