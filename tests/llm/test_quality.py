import random
import zlib

import numpy as np

from tracewinnow.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels)
    rows = Q.classify(docs, model).join(labels, "doc_id").toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    out = rows[rows["held_out"]]
    assert len(out) > 40 and (out["predicted"] == out["quality"]).mean() >= 0.95
    assert ((rows["score"] >= 0.3) == rows["predicted"]).all() and rows["score"].between(0, 1).all()


def test_held_out_labels_dont_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert Q.train(docs, labels) == Q.train(docs, flipped)


def test_column_equals_numpy(spark, odd):
    r = np.random.default_rng(0)
    x = np.column_stack([r.random(400) for _ in Q.STATS])
    y = ((x[:, 0] > 0.5) & (x[:, 4] < 0.6)).astype(float)
    model = Q.fit(x, y)
    assert model.rules and ((model.score(x) >= 0.5) == y).mean() > 0.97
    stats = Q.statistics([(row.text or "").encode() for row in odd.collect()])
    got = sorted(row.score for row in Q.classify(odd, model).collect())
    assert np.allclose(got, sorted(model.score(stats)))


def test_lasso_leaves_rules_out():
    r = np.random.default_rng(1)
    a = r.random((2000, 40)) > 0.5
    y = (a[:, 0] | a[:, 1]).astype(float)
    w, _ = Q.lasso_logistic(a.astype(float), y, 0.02)
    assert np.abs(w[:2]).min() > 0 and (np.abs(w) > 1e-6).sum() < 10


def test_statistics():
    text = b"Ab cd!! |\nAb cd!! |\n"
    row = dict(zip(Q.STATS, Q.statistics([text, b"", b"   "])[0]))
    assert row["upper"] == 2 / 20 and row["exclaim"] == 4 / 20 and row["pipe"] == 2 / 20 and row["lines"] == 2 / 20
    assert row["repeated_lines"] == 0.5 and row["distinct_words"] == 0.5 and row["symbol_words"] == 4 / 6 and row["capital_words"] == 2 / 6
    many = [b"x%d y" % i for i in range(50)]
    assert np.array_equal(Q.statistics(many), np.concatenate([Q.statistics([t]) for t in many]))


def test_no_labels(spark, odd):
    for labels in ([], [(1, None)], [(1, 1), (2, 1), (3, 1), (4, 1)]):
        df = spark.createDataFrame(labels, "doc_id long, quality int")
        assert all(0 < r.score < 1 for r in Q.classify(odd, Q.train(odd, df)).collect())


def test_keep_good(spark, odd, clashing, empty):
    rng = random.Random(0)
    texts = [(i, "fine words stand here " * rng.randint(1, 5) if i % 2 else "BAD$$$ ###WORDS !! " * rng.randint(1, 5)) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = Q.train(docs, spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int"))
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {1} and kept.count() == 200
    assert Q.keep_good(clashing, model).columns == clashing.columns and Q.keep_good(empty, model).count() == 0


def test_repeated_ids_with_other_texts(spark):
    """Training takes one text of an id, the same on every run and in every order."""
    rng = random.Random(0)
    texts = [(i, ("fine words stand here " if (i + k) % 2 else "BAD$$$ ###WORDS !! ") * rng.randint(1, 5)) for i in range(300) for k in range(2)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    models = []
    for n in (1, 4):
        rng.shuffle(texts)
        models.append(Q.train(spark.createDataFrame(texts, "doc_id long, text string").repartition(n), labels))
    assert models[0] == models[1]


def test_score_by_hand(spark):
    """The score of a known ensemble, from the statistics' definitions written out anew."""
    model = Q.RuleEnsemble((Q.Rule(((Q.STATS.index("upper"), True, 0.25),), -2.0), Q.Rule(((Q.STATS.index("mean_word"), False, 4.0), (Q.STATS.index("distinct_words"), True, 0.5)), 1.5)), 0.5)
    texts = ["", "AAA b", "a b c", "a a a a", "LOUD WORDS EVERYWHERE", "longer words standing alone", "é ü", None]
    got = {r.doc_id: r for r in Q.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        w = text.split()
        z = 0.5
        if sum("A" <= c <= "Z" for c in text) / max(1, len(text)) > 0.25:
            z -= 2.0
        if (sum(len(x.encode()) for x in w) / max(1, len(w))) <= 4 and (len(set(w)) / len(w) if w else 0) > 0.5:
            z += 1.5
        assert abs(got[i].score - 1 / (1 + 2.718281828459045**-z)) < 1e-9 and got[i].predicted == (got[i].score >= 0.3)


def test_contract(agree):
    x = np.random.default_rng(0).random((300, len(Q.STATS)))
    model = Q.fit(x, (x[:, 0] > 0.5).astype(float))
    agree(lambda df: Q.classify(df, model))
