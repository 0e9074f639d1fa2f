import re

import corpus_pipeline
from brute import fingerprint, roots
from test_simhash import family, jaccard

from tracewinnow.llm import mixing, quality, queries, tokens
from tracewinnow.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    before = dict(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, SF), "test")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            after = [(r.doc_id, r.text or "") for r in docs.collect()]
            assert all(before[d] == t for d, t in after)
        if k == 0:
            model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
            ids = sorted(before)
            scores = model.score(quality.statistics([before[i].encode() for i in ids]))
            assert {d for d, _ in after} == {i for i, s in zip(ids, scores) if s >= 0.3}
        elif k == 1:
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
            assert sorted(d for d, _ in after) == sorted(first.values())
        elif k == 2:
            fp = {i: fingerprint(before[i]) for i in before}
            sets = {i: shingles(before[i]) for i in before}
            like = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])  # noqa: B023,E731
            number = roots(sorted(before), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3 or like(i, j))  # noqa: B023
            assert sorted(d for d, _ in after) == sorted(set(number.values()))
        elif k == 3:
            took = {r.doc_id: r.copies for r in mixing.mix(last).collect()}
            assert sorted(d for d, _ in after) == sorted(d for d, c in took.items() for _ in range(c))
        if k < len(corpus_pipeline.STAGES) - 1:
            before, last = dict(after), docs
    t = tokens.Transducer(open(tokens.default_model(), "rb").read())
    rows = docs.collect()
    assert len(rows) == len(after) and all(t.decode(list(r.ids)) == before[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


def shingles(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}


def test_stages_on_odd_rows(spark, odd, clashing, empty):
    """Missing and repeated ids, nulls, clashing columns and no rows: each stage gives rows of its input with their columns, once or as often as it says."""
    rows = {tuple(map(str, r)) for r in odd.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, odd, SF).collect()
        assert stage(spark, empty, SF).count() == 0, name
        again = stage(spark, clashing, SF)
        assert again.count() == len(got), name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert again.columns == clashing.columns and {tuple(map(str, r)) for r in got} <= rows, name


def test_near_copies_at_any_distance(spark):
    """The stage leaves no two texts with a similarity of 0.8, also where fingerprints differ in more than 6 bits."""
    texts = family(1)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fp = {i: fingerprint(t) for i, t in texts.items()}
    linked = lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3 or jaccard(texts[i], texts[j]) >= 0.8
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, SF).collect())
    assert kept == sorted(set(roots(sorted(texts), linked).values()))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_every_operator_is_registered(spark):
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    n = table(spark, SF, "documents").count()
    for name in names:
        assert queries.QUERIES[name](spark, SF).count() == n, name
