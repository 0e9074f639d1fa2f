import random

import numpy as np
import pyarrow as pa
from brute import fingerprint, roots

from tracewinnow.llm import simhash as H


def test_fingerprints(odd, small):
    for df in (odd, small):
        got = sorted((r.fp & (1 << 64) - 1) for r in H.fingerprints(df).collect())
        assert got == sorted(fingerprint(r.text) for r in df.collect())


def components_of(rows):
    """(id, fingerprint) rows to the component of each fingerprint: its smallest id."""
    names = sorted({f for _, f in rows})
    number = roots(range(len(names)), lambda i, j: (names[i] ^ names[j]).bit_count() <= 3)
    low = {}
    for d, f in rows:
        if d is not None:
            part = number[names.index(f)]
            low[part] = min(d, low.get(part, d))
    return {f: (number[i], low.get(number[i])) for i, f in enumerate(names)}


def test_components(odd, small):
    for df in (odd, small):
        rows = [(r.doc_id, fingerprint(r.text)) for r in df.collect()]
        want = components_of(rows)
        got = H.near_duplicates(df).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == want[int(r.fingerprint, 16)][1]


def test_tables_share_a_key_for_every_close_pair():
    """Also where the finer tables of a hot key take over."""
    r = random.Random(4)
    every = (1 << 64) - 1
    for bits, tables in ((3, 20), (6, 84)):
        masks = H.choices(every, H.blocks_for(bits), bits)
        assert len(masks) == tables
        for _ in range(100):
            flips = sum(1 << b for b in r.sample(range(64), bits))
            shared = [m for m in masks if not flips & m]
            assert shared
            for m in shared:
                assert any(not flips & f for f in H.choices(every ^ m, H.parts_for(bits), bits))
    masks = H.choices(every, H.blocks_for(3), 3)
    assert max(64 - (m | f).bit_count() for m in masks for f in H.choices(every ^ m, H.parts_for(3), 3)) <= 9


def fps_around(rng, centres, each, far):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            out.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, far))))
    return sorted(out)


def test_crowded_keys(spark):
    """Groups beyond the wide limit, and beyond the small one, against all pairs."""
    fps = fps_around(random.Random(9), 4, 120, 4)
    number = roots(range(len(fps)), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    reps = spark.createDataFrame([(i, H.signed(f)) for i, f in enumerate(fps)], "id long, fp long")
    for wide in (10, 10**6):
        got = {r.node: r.root for r in H.components(H.edges_of(reps, wide=wide)).collect()}
        assert all(got.get(i, i) == number[i] for i in range(len(fps)))


def test_edges_are_linear_in_a_group():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 6, 5000, dtype=np.uint64))
    edges = np.concatenate(H.pairs_in_groups(np.zeros(len(fps), np.int64), np.arange(len(fps)), fps, 3))
    assert len(edges) == len(fps) - 1


def test_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    pairs = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:])]
    got = {r.node: r.root for r in H.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, n)}


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def family(seed):
    """Copies of a few texts with some words changed."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(25):
        own = [word() for _ in range(250)]
        texts.append(" ".join(own))
        for _ in range(3):
            copy = list(own)
            for _ in range(r.choice([1, 3, 6, 12])):
                copy[r.randrange(250)] = word()
            texts.append(" ".join(copy))
    return dict(enumerate(texts))


def test_wider_links(spark):
    """3 bits link, and up to 6 bits if the shingles are alike; against all pairs."""
    texts = family(1)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    fp = {i: fingerprint(t) for i, t in texts.items()}

    def linked(i, j):
        d = (fp[i] ^ fp[j]).bit_count()
        return d <= 3 or d <= 6 and jaccard(texts[i], texts[j]) >= 0.8

    want = roots(sorted(texts), linked)
    got = {r.doc_id: r.component_id for r in H.near_duplicates(df, wider_bits=6).collect()}
    assert got == want and len(set(got.values())) < len({r.component_id for r in H.near_duplicates(df).collect()})
    assert sorted(r.doc_id for r in H.keep_one(df).collect()) == sorted(set(want.values()))


def test_wider_links_among_dissimilar_hubs(spark):
    """Pairs of near copies amid many texts that are as close to both, but not similar: more than a small group has."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))

    def changed(own, n):
        copy = list(own)
        for i in r.sample(range(len(own)), n):
            copy[i] = word()
        return copy

    base, texts = [word() for _ in range(1500)], []
    for _ in range(60):
        one = changed(base, 30)
        texts += [" ".join(one), " ".join(changed(one, 25))]
    fp = [fingerprint(t) for t in texts]

    def linked(i, j):
        d = (fp[i] ^ fp[j]).bit_count()
        return d <= 3 or d <= 6 and jaccard(texts[i], texts[j]) >= 0.8

    want = roots(range(len(texts)), linked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in H.near_duplicates(df, wider_bits=6).collect()} == want


def rows_of(cols, names, each):
    return iter([pa.RecordBatch.from_arrays([pa.array(c[i : i + each]) for c in cols], names=names) for i in range(0, len(cols[0]), each)])


def test_large_groups_are_tried_whole():
    """Links join what all similar pairs of a group would, also across batches, and are no more than needed; stars are linear."""
    n = 50
    cols = [np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), np.full(n, 9), np.arange(n) // 2]
    names = ["key", "id", "fp", "n", "label"]
    pairs = lambda run: sorted((a, b) for x in run for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist()))
    assert len(pairs(H.unlinked(6, 0.8)(rows_of(cols, names, 7)))) == n - 2
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(60)]
    sets = [sorted({*r.sample(base, r.choice([50, 54, 57])), *(r.getrandbits(64) for _ in range(r.choice([0, 3, 9])))}) for _ in range(n)]
    like = lambda i, j: len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})
    fps = np.arange(n) * 1000
    got = [(a // 1000, b // 1000) for x in H.verified(64, 0.8)(rows_of([cols[0], fps, fps, [np.array(x, dtype=np.uint64).tobytes() for x in sets]], ["key", "fp", "label", "set"], 7)) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist())]
    want = roots(range(n), like)
    assert all(like(i, j) for i, j in got) and roots(range(n), lambda i, j: (i, j) in got) == want
    assert 1 < len(set(want.values())) < n - 5 and len(got) == n - len(set(want.values()))


def test_crowded_bands(spark):
    """Wide groups are keyed again with more bands and lose no pair of near copies; two families far apart stay so."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, texts = [word() for _ in range(120)], []
    for _ in range(40):
        own = passage + [word() for _ in range(40)]
        texts += [" ".join(own), " ".join([*own[:-3], word(), word(), word()])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = H.materialise(H.fingerprints(df, similar_shingle=5), "test")
    none = spark.createDataFrame([], "a long, b long")
    fp = {r.doc_id: r.fp for r in rows.collect()}
    want = roots(range(len(texts)), lambda i, j: fp[i] == fp[j] or jaccard(texts[i], texts[j]) >= 0.8)
    for wide, rounds in ((10, 1), (10**6, 2)):
        links = H.wider_links(df, rows, none, 64, 0.8, 5, wide=wide, rounds=rounds).collect()
        number = roots(range(len(texts)), lambda i, j: any({fp[i], fp[j]} == {x.a, x.b} for x in links))  # noqa: B023
        assert number == want


def test_keep_one(spark, odd, odd_rows, clashing, empty):
    """One row a component, whatever ids repeat or are missing."""
    more = [(7, "one two three four five six", "en", "s", 1), (7, "wholly other words stand in this text here", "en", "s", 1), (3, "one two three four five six", "en", "s", 1), (None, "one  two three four five six", "en", "s", 1), (None, "nothing like the rest of all these", "en", "s", 1), (None, "nothing like the rest of all these", "en", "s", 1)]
    for rows in (odd_rows, more, odd_rows + more):
        df = spark.createDataFrame(rows, odd.schema).repartition(3)
        parts = components_of([(r[0], fingerprint(r[1])) for r in rows])
        kept = H.keep_one(df, wider_bits=0)
        assert kept.columns == odd.columns
        got = sorted((parts[fingerprint(r.text)][0], -1 if r.doc_id is None else r.doc_id) for r in kept.collect())
        assert got == sorted({(part, -1 if low is None else low) for part, low in parts.values()})
        assert all(tuple(r) in {tuple(x) for x in rows} for r in kept.collect())
    assert H.keep_one(df).count() <= kept.count()
    assert H.keep_one(clashing, wider_bits=0).columns == clashing.columns
    assert H.keep_one(empty).count() == 0 and H.keep_one(empty).columns == empty.columns


def test_contract(agree):
    agree(H.near_duplicates)
