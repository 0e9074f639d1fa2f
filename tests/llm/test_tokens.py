import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewinnow.llm import tokens as K

MODEL = open(K.default_model(), "rb").read()
OURS = K.Transducer(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ids = lambda text: np.frombuffer(OURS.encode(text), dtype=np.int32).tolist()


def test_library_and_round_trip(odd, small):
    for r in [*odd.collect(), *small.collect()]:
        text = r.text or ""
        own = ids(text)
        assert OURS.decode(own) == text
        if K.MARK not in text:
            assert own == LIBRARY.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode(errors="ignore").decode()
    assert OURS.decode(ids(text)) == text
    if K.MARK not in text:
        assert ids(text) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinorst ", max_size=40))
def test_words(text):
    assert ids(text) == LIBRARY.encode(text)


def test_unigram_path_is_the_cheapest():
    """A unigram model from a few pieces: the path found costs no more than any split."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(MODEL)
    del m.pieces[:]
    for p, s in (("a", -3.0), ("b", -3.5), ("ab", -4.0), ("ba", -5.0), ("aba", -6.5), (K.MARK, -1.0), (K.MARK + "a", -2.5)):
        x = m.pieces.add()
        x.piece, x.score, x.type = p, s, 1
    for b in range(256):
        x = m.pieces.add()
        x.piece, x.score, x.type = f"<0x{b:02X}>", 0.0, K.BYTE
    m.trainer_spec.model_type = 1
    t = K.Transducer(m.SerializeToString())

    def best(word):
        if not word:
            return 0.0
        return min((-t.score[t.piece[word[:n]]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in t.piece), default=float("inf"))

    for word in ("ab", "abab", "baab", "aabba", "abaaba"):
        own = np.frombuffer(t.encode(word), dtype=np.int32).tolist()
        assert abs(sum(-t.score[i] for i in own) - best(K.MARK + word)) < 1e-9


def variant(change):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(MODEL)
    change(m)
    return m.SerializeToString()


def weight_of(t, path):
    """The weight of a path through the composition, from the definition; None stands for a character that no piece is."""
    total, before = 0.0, -1
    for p in path:
        total += K.UNKNOWN if p is None else t.weight[p] + (0 if t.allowed(before, p) else K.BORDER)
        before = -1 if p is None else p
    return total


def every_path(t, word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in t.piece:
            yield from ([t.piece[word[:n]], *rest] for rest in every_path(t, word[n:]))
    if word and word[0] not in t.piece:
        yield from ([None, *rest] for rest in every_path(t, word[1:]))


def test_weights_decide():
    """Of all paths through a word the library's encoding alone has the least weight, and so it is found one by one and side by side."""
    words = [K.MARK + w for w in ("hello", "there", "lower", "aaaaa", "token", "unrelated", "ﷺab", "x1y2", "queue")]
    for w in words:
        ranked = sorted((weight_of(OURS, p), p) for p in every_path(OURS, w) if None not in p) or [(0, None)]
        if ranked[0][1]:
            assert len(ranked) < 2 or ranked[0][0] < ranked[1][0]
            assert ranked[0][1] == OURS.shortest(w) == LIBRARY.encode(w[1:])
            assert any(cost >= K.BORDER for cost, _ in ranked)
    many = sorted({K.MARK + w[:k] for w in ("international", "understanding", "representative", "characterisation") for k in range(1, 17)})
    assert len(many) >= K.FEWEST
    fresh = K.Transducer(MODEL)
    assert [np.frombuffer(p, dtype=np.int32).tolist() for p in fresh.solve(many)] == [LIBRARY.encode(w[1:]) for w in many]


def test_small_memories(small, monkeypatch):
    """Neither what is remembered nor the size of tables and blocks changes a result."""
    texts = [r.text or "" for r in small.collect()]
    expected = [LIBRARY.encode(t) for t in texts if K.MARK not in t]
    for name, value in (("REMEMBERED", 5_000), ("LONGEST", 3), ("BORDERS", 64), ("BLOCK", 50), ("WIDEST", 7), ("COLUMNS", 16)):
        monkeypatch.setattr(K, name, value)
    t = K.Transducer(MODEL)
    for _ in range(2):
        flat, at = t.encode_all([x for x in texts if K.MARK not in x])
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == expected
    assert t.held <= 5_000 + 1_000


def test_long_words():
    text = "ab" * 30_000 + "日本語" * 5_000 + " \n" + "x" * 100 + "😀" * 300
    assert ids(text) == LIBRARY.encode(text) and OURS.decode(ids(text)) == text


def test_character_map():
    """Normalising models: rules, white space and prefix as in the library."""
    for rule, dummy, extra in (("nmt_nfkc", True, True), ("nfkc_cf", True, False), ("nmt_nfkc_cf", False, True)):
        spec = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, escape_whitespaces=True, remove_extra_whitespaces=extra).serialized_model_proto()

        def change(m):
            from sentencepiece import sentencepiece_model_pb2 as pb

            own = pb.ModelProto()
            own.ParseFromString(spec)  # noqa: B023
            m.normalizer_spec.CopyFrom(own.normalizer_spec)

        model = variant(change)
        t, library = K.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
        for text in ("Ｆｕｌｌ ｗｉｄｔｈ", "  two  spaces  ", "ﬁne ① ½ e\u0301 ガ", "Straße İ ǅ", "한글 한글", "", "   ", "tab\tand\nline", "ﷺ", "a\u0300\u0316 x"):
            assert np.frombuffer(t.encode(text), dtype=np.int32).tolist() == library.encode(text), (rule, text)


def test_user_defined_pieces():
    def change(m):
        for p in m.pieces:
            if p.piece in ("ing", "the"):
                p.type = K.USER_DEFINED

    model = variant(change)
    t, library = K.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in ("the thing", "bathe ingenthe", "nothing at all", "ing", "the", "singing the theme"):
        own = np.frombuffer(t.encode(text), dtype=np.int32).tolist()
        assert own == library.encode(text) and t.decode(own) == text


def test_models_that_are_refused():
    def no_bytes(m):
        for p in m.pieces:
            if p.type == K.BYTE:
                p.type = 5

    def suffix(m):
        m.trainer_spec.treat_whitespace_as_suffix = True

    for change in (no_bytes, suffix):
        with pytest.raises(ValueError):
            K.Transducer(variant(change))


def test_digests(odd):
    """The registered digests against the library, the literal marks apart."""
    texts = {r.doc_id: r.text or "" for r in odd.filter("doc_id <> 11").collect()}
    for r in K.token_digest(odd.filter("doc_id <> 11")).collect():
        text = texts[r.doc_id]
        assert (r.decoded_bytes, r.decoded_sha256) == (len(text.encode()), hashlib.sha256(text.encode()).hexdigest())
        if K.MARK not in text:
            own = LIBRARY.encode(text)
            assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())


def test_contract(agree):
    agree(K.token_digest)


def test_operator(odd):
    for r in K.encode(odd).collect():
        assert r.n_tokens == len(r.ids)
    assert {r.decoded for r in K.encode(odd).collect()} == {r.text or "" for r in odd.collect()}
