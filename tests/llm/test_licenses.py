import random
import re

from tracewinnow.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = plain_words(text)
    at, labels = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(odd, small):
    for df in (odd, small):
        key = lambda x: tuple(-1 if v is None else v for v in x)
        want = sorted((base(r.text) for r in df.collect()), key=key)
        got = sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.license_scan(df).collect()), key=key)
        assert got == want


def test_matching_statistics_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        texts = [[r.randrange(3) for _ in range(r.randint(1, 12))] for _ in range(3)]
        auto = L.Automaton(texts)
        ids = [r.randrange(4) for _ in range(25)]
        inside = lambda part: any(t[i : i + len(part)] == part for t in texts for i in range(len(t)))  # noqa: B023,E731
        for i, (s, n) in enumerate(auto.statistics(ids)):
            want = max((k for k in range(i + 2) if inside(ids[i + 1 - k : i + 1])), default=0)
            assert n == want
            if n:
                part = ids[i + 1 - n : i + 1]
                ends = {(t, k + n - 1) for t, own in enumerate(texts) for k in range(len(own)) if own[k : k + n] == part}
                assert {(t, e) for t, own in auto.ends[s].items() for e in own} == ends


def scan(text):
    return L.Scanner().scan([text.encode()])[0]


def test_templates_are_found_whole_and_changed():
    for label, template in L.TEMPLATES:
        n, _, spans = scan("before it stands this " + template + " and after it that")
        assert any(s[0] == label and s[3] == 1.0 and s[1] == 4 for s in spans), template
    for text in (L.TEMPLATES[0][1], f"{L.BSD_TERMS} {L.BSD_NAMES} {L.BSD_DISCLAIMER}", f"{L.ISC_TERMS} {L.ISC_DISCLAIMER}"):
        changed = text.split()
        changed[20:22] = ["something", "else"]
        del changed[-9]
        spans = scan(" ".join(changed))[2]
        assert len({s[0] for s in spans}) == 1 and 0.85 < max(s[3] for s in spans) < 1
    assert scan("the software is of the and to use in any the license of the work")[2] == []


def test_scores(spark):
    rows = [(1, "mit license"), (2, "nothing here"), (3, "Licensed under the Apache License, Version 2.0."), (4, None)]
    got = {r.doc_id: (r.labels, r.score) for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit", L.MIN_COVER), 2: ("", 0.0), 3: ("apache", 1.0), 4: ("", 0.0)}


def test_contract(agree):
    agree(L.license_scan)


def test_chains_look_at_every_match_within_the_gap():
    """Over 64 matches of the template lie between two that chain."""
    s = L.Scanner((("x", " ".join(f"w{i}" for i in range(200))),), ())
    found = [(0, 0, 3, 3), *((0, 4, 7, e) for e in range(100, 180)), (0, 8, 11, 11)]
    assert any(n == 8 / 200 and (first, last) == (0, 11) for n, _, first, last in s.chains(found))


def plain_matches(templates, ids):
    """Per template: common runs that can be lengthened on neither side, from all pairs of places."""
    out = set()
    for t, own in enumerate(templates):
        longest = [max((k for k in range(i + 2) if any(own[e - k + 1 : e + 1] == ids[i - k + 1 : i + 1] for e in range(k - 1, len(own)))), default=0) for i in range(len(ids))]
        for i, n in enumerate(longest):
            if n >= L.MIN_WORDS and (i + 1 == len(ids) or longest[i + 1] != n + 1):
                out |= {(t, i - n + 1, i, e) for e in range(n - 1, len(own)) if own[e - n + 1 : e + 1] == ids[i - n + 1 : i + 1]}
    return out


def plain_chains(own, size):
    """Cover of the best chain that ends in each match, by trying every match before."""
    own = sorted((b, a, e) for a, b, e in own)
    best = []
    for k, (b, a, e) in enumerate(own):
        top = b - a + 1
        for j, (bj, aj, ej) in enumerate(own[:k]):
            if bj < b and ej < e and a - bj - 1 <= L.MAX_GAP:
                top = max(top, best[j] + min(b - a + 1, b - bj, e - ej))
        best.append(top)
    return max(best) / size


def test_matches_and_chains_against_brute_force():
    """Matches of every template by itself, and the cover of its best chain, over texts of few words."""
    r = random.Random(6)
    for k in range(120):
        templates = [" ".join(r.choice("abcd") + "x" for _ in range(r.randint(5, 25))) for _ in range(3)]
        scanner = L.Scanner(tuple((str(i), t) for i, t in enumerate(templates)), ())
        text = []
        for _ in range(6):
            t = r.choice(templates).split()
            i = r.randrange(len(t))
            text += t[i : i + r.randint(1, 12)] + [r.choice("abcde") + "x" for _ in range(r.choice([0, 0, 2, 14]))]
        ids = [scanner.vocab.get(w.encode(), len(scanner.vocab)) for w in text]
        coded = [[scanner.vocab[w.encode()] for w in t.split()] for t in templates]
        got = set(scanner.matches(ids, 0))
        assert got == plain_matches(coded, ids)
        for t, own in enumerate(coded):
            mine = [m[1:] for m in got if m[0] == t]
            if mine:
                assert abs(max(c for c, u, *_ in scanner.chains(list(got)) if u == t) - plain_chains(mine, len(own))) < 1e-9


def test_a_template_inside_a_longer_match():
    """A short template whose match runs on in a longer one is covered all the same."""
    spans = scan("Licensed under the Apache License, Version 2.0. The code may not be used")[2]
    assert ("apache", 0, 8, 1.0) in spans


def test_labels_and_scores_against_brute_force(small):
    """Labels and score of whole documents, from the plain matches and chains over each text."""
    templates = [[w.decode() for w in L.words(t.encode())] for _, t in L.TEMPLATES]
    inside = {tuple(t[i : i + L.MIN_WORDS]) for t in templates for i in range(len(t) - L.MIN_WORDS + 1)}
    seen = 0
    for r in L.license_scan(small).join(small, "doc_id").collect():
        w = plain_words(r.text)
        spots = [i for i in range(len(w) - L.MIN_WORDS + 1) if tuple(w[i : i + L.MIN_WORDS]) in inside]
        if not spots:
            assert r.labels == r.base_labels and r.score == (L.MIN_COVER if r.n_base else 0)
            continue
        part = w[spots[0] : spots[-1] + L.MIN_WORDS]
        if len(part) > 300:
            continue
        seen += 1
        found = plain_matches(templates, part)
        covers = {}
        for t, own in enumerate(templates):
            if mine := [m[1:] for m in found if m[0] == t]:
                covers[t] = plain_chains(mine, len(own))
        good = {t: min(1.0, c) for t, c in covers.items() if c >= L.MIN_COVER}
        labels = {L.TEMPLATES[t][0] for t in good} | set(filter(None, r.base_labels.split(",")))
        score = max(good.values(), default=0.0)
        assert r.labels == ",".join(sorted(labels)) and abs(r.score - (max(score, L.MIN_COVER) if r.n_base else score)) < 1e-9
    assert seen >= 3
