import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tracewinnow.llm.exact_dedup import exact_dedup, keep_first


def expected(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = groups[norm(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep))
    return Counter(out)


def test_against_brute_force(odd, odd_rows):
    got = exact_dedup(odd).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == expected(odd_rows)


def test_colliding_digests(odd, odd_rows):
    """With a digest of one of four values nearly all texts collide; the texts themselves decide."""
    weak = lambda c: F.unhex(F.concat(F.lit("0"), (F.crc32(c) % 4).cast("string")))
    got = exact_dedup(odd, digest=weak, salts=2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == expected(odd_rows)


def test_hot_group(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert all(got[i] == ((0, 1000) if i % 3 == 0 else (i, 1)) for i in range(3000))


def first_rows(rows):
    """The texts that stay, each with the smallest id; none last."""
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        place = (r[0] is None, r[0] or 0)
        if key not in best or place < best[key][0]:
            best[key] = (place, key)
    return sorted((place, key) for place, key in best.values())


def test_keep_first(spark, odd, odd_rows, clashing, empty):
    """One row a text: also where ids repeat with other texts, and where they are missing."""
    weak = lambda c: F.unhex(F.concat(F.lit("0"), (F.crc32(c) % 4).cast("string")))
    more = [(1, "alpha beta", "en", "s", 1), (2, "alpha  beta", "en", "s", 1), (2, "a unique text of id 2", "en", "s", 1), (None, "alpha beta", "en", "s", 1), (None, "a text without id", "en", "s", 1), (None, "a text without id", "en", "s", 1), (None, "a text without id", "de", "s", 1)]
    for rows in (odd_rows, more, odd_rows + more):
        df = spark.createDataFrame(rows, odd.schema).repartition(3)
        for options in ({}, {"digest": weak, "salts": 2}):
            kept = keep_first(df, **options)
            assert kept.columns == odd.columns
            assert first_rows([(r.doc_id, r.text) for r in kept.collect()]) == first_rows(rows) and kept.count() == len(first_rows(rows))
            assert all(tuple(r) in {tuple(x) for x in rows} for r in kept.collect())
    assert [r.lang for r in keep_first(spark.createDataFrame(more, odd.schema)).filter("text = 'a text without id'").collect()] == ["de"]
    assert keep_first(clashing).columns == clashing.columns and keep_first(clashing).count() == len(first_rows(odd_rows))
    assert keep_first(empty).count() == 0 and keep_first(empty).columns == empty.columns


def test_contract(agree):
    agree(exact_dedup)


def test_native(odd):
    plan = exact_dedup(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
