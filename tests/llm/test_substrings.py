import hashlib
import random

import pyarrow as pa
from brute import repeated_bytes

from tracewinnow.llm import substrings as S


def got(df, **options):
    return {(r.doc_id, r.n_bytes): (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in S.dedup_substrings(df, **options).collect()}


def want(texts):
    return {(k, v[0]): v for k, v in repeated_bytes(texts).items()}


def generated(seed, docs=300):
    r = random.Random(seed)
    letters = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    shared = [letters(r.randint(90, 250)) for _ in range(6)]
    out = {}
    for i in range(docs):
        text = letters(r.randint(0, 200))
        for _ in range(r.randint(0, 2)):
            p = r.choice(shared)
            a = r.randint(0, 30)
            text += p[a : a + r.randint(80, 250)] + letters(r.randint(0, 120))
        out[i] = "ab" * r.randint(40, 150) + text if i % 13 == 0 else text
    return out


def test_against_brute_force(spark, small):
    texts = generated(1)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert got(df) == want(texts)
    assert got(small) == want({r.doc_id: r.text or "" for r in small.collect()})


def test_hot_grams_and_small_chunks(spark):
    """Salted grams and grams in parts give the same result."""
    texts = generated(2)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert got(df, locally_hot=2, chunk=5) == got(df, locally_hot=10**9, chunk=10**9) == want(texts)


def test_odd_rows(odd, odd_rows):
    """Rows without an id come last; a repeated row is the same place as the first."""
    places = {}
    for doc, text, *_ in odd_rows:
        places[(doc is None, doc or 0, text or "")] = text or ""
    plain = {k: v for k, v in repeated_bytes(places).items()}
    rows = S.dedup_substrings(odd).collect()
    assert len(rows) == len(odd_rows)
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in rows if r.doc_id not in (11, None)} == {(k[1], v[0], v[1]) for k, v in plain.items() if not k[0] and k[1] != 11}


def test_contract(agree):
    agree(S.substring_digest)


def test_common_extension_with_colliding_hashes():
    s = S.Suffixes([b"abcdef", b"abcxef", b"abc", b"abcdef"])
    assert [s.common(0, 1), s.common(0, 2), s.common(0, 3)] == [3, 3, 6]
    s.sums = [0] * len(s.sums)  # every hash collides
    assert [s.common(0, 1), s.common(0, 2), s.common(0, 3)] == [3, 3, 6]
    assert s.ordered([0, 1, 2, 3])[0] == [2, 0, 3, 1]


def test_thue_morse(spark):
    """Strings whose polynomial hashes modulo a power of two collide."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = {0: a, 1: b, 2: "c" + a[:700], 3: b[100:900] + "d"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got(df) == want(texts)


def test_colliding_segment_hashes(monkeypatch):
    """With hashes of two values nearly all segments of a gram collide in a task; the bytes decide."""
    plain = S.segments

    def weak(data, sizes):
        text, gram, whole, *rest = plain(data, sizes)
        return text, gram, whole & 1, *rest

    monkeypatch.setattr(S, "segments", weak)
    texts = generated(4, 60)
    rows = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array([0] * len(texts)), pa.array(list(texts.values()))], names=["doc", "tag", "text"])
    held = pa.Table.from_batches(S.find(iter([rows]), 64)).to_pylist()
    monkeypatch.setattr(S, "segments", plain)
    same = pa.Table.from_batches(S.find(iter([rows]), 64)).to_pylist()

    def decided(rows):
        """Windows that are said to repeat within the task."""
        return {(r["doc"], first + k) for r in rows for first, _, count, flag in [S.unpack(r["packed"])] if flag == S.DONE for k in range(count)}

    seen = {}
    for d, t in sorted(texts.items()):
        b = t.encode()
        for i in range(len(b) - S.LENGTH + 1):
            seen.setdefault(b[i : i + S.LENGTH], (d, i))
    repeats = {(d, i) for d, t in texts.items() for i in range(len(t.encode()) - S.LENGTH + 1) if seen[t.encode()[i : i + S.LENGTH]] != (d, i)}
    assert decided(held) <= repeats and decided(same) <= repeats and decided(same)


def test_digests(small):
    """The registered digests against the brute-force version."""
    plain = repeated_bytes({r.doc_id: r.text or "" for r in small.collect()})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.substring_digest(small).collect()}
    assert got == plain
