"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.

Beside them there are candidate spans of other kinds: ``secret`` (tokens such as
keys and passwords: those with letters and digits, those assigned to a name of
the gazetteers, and long ones of mixed case, digits or not) and ``number``
(telephone-like and identity numbers that no base pattern takes).  Labelers of three sorts vote on
each candidate: regular expressions, gazetteers and the words around it.  Votes
are counted over the whole corpus; there are at most ``3 ** labelers`` vote
patterns of a kind, times a few shape buckets, so the counts fit on the driver.
Expectation-maximisation estimates from them how reliable each labeler is and
how likely each pattern is personal data, and those probabilities train a
logistic span classifier over votes and shape.  A candidate is a span if the
classifier says so.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, slices

#: Kinds with fixed patterns, in their order; those of the classifier follow.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "number", "secret")

# Fixed patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every ip, card and phone match lies within one of these stretches.
ISLAND = re.compile(r"[0-9+][0-9+.()\x20-]*")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches, each ``@`` looked at once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str, islands: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind."""
    out = emails(text)
    for a, b in islands:
        if b - a < 7:
            continue
        for m in IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text, a, b):
            d = digits_of(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text, a, b):
            if 10 <= len(digits_of(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- candidates and labelers -------------------------------------------------

TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-/+.")
KEY_VALUE = re.compile(r"(?:^|[^A-Za-z])([A-Za-z_][A-Za-z_-]{1,24})[\"']?\s{0,2}[=:]\s{0,2}[\"'`]?\Z")
#: Gazetteers.  Names that secrets are assigned to, usual beginnings of keys, and words before numbers.
SECRET_NAMES = frozenset(["password", "passwd", "pwd", "passphrase", "secret", "token", "key", "apikey", "api_key", "access_key", "secret_key", "auth", "credential", "private_key"])
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xox", "sk-", "sk_", "pk_", "AIza", "eyJ")
HARMLESS_NAMES = frozenset(["sha", "sha1", "sha256", "md5", "commit", "hash", "checksum", "digest", "version", "id", "rev", "href", "src", "url"])
NUMBER_WORDS = frozenset(["phone", "tel", "telephone", "mobile", "cell", "call", "fax", "ssn", "social", "passport", "account", "iban"])
PHONE_SHAPE = re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}\Z")
IDENTITY_SHAPE = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}\Z")
#: Either shape within an island.
NUMBER = re.compile(r"(?<![0-9])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z_])")
#: The fewest characters of a candidate for a secret: with letters and digits, assigned to a listed name, and of mixed case.
WITH_DIGITS, ASSIGNED, MIXED = 12, 6, 24
#: What labelers of the context see before a candidate: characters, and the last words of those.
CONTEXT, NEAR = 40, 3
SIGN = re.compile(r"[=:]\s{0,2}[\"'`]?")
TOKEN = re.compile(r"[A-Za-z0-9_/+.-]+")
LONG = re.compile(r"[A-Za-z0-9_/+.-]{%d,}" % MIXED)
HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
WORDLIKE = re.compile(r"[A-Z]?[a-z]{4,}|[A-Z]{5,}")
WORD_BEFORE = re.compile(r"[A-Za-z]+")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in (text.count(c) for c in set(text)))


def vote(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


def assigned_name(before: str) -> str:
    """The name that an assignment at the end of ``before`` is to, in lower case; empty if there is none."""
    m = KEY_VALUE.search(before)
    return m.group(1).lower() if m else ""


def secret_votes(text: str, a: int, b: int) -> str:
    token = text[a:b]
    before = text[max(0, a - CONTEXT) : a]
    name = assigned_name(before)
    near = [w.lower() for w in WORD_BEFORE.findall(before)][-NEAR:]
    letters, kinds = sum(c.isalpha() for c in token), len(set(token))
    h = entropy(token)
    wordless = bool(HEX.match(token)) or not any(set("aeiouy") & set(w.lower()) for w in WORDLIKE.findall(token))
    votes = (
        vote(bool(HEX.match(token)) and len(token) >= 24 or bool(re.match(r"[A-Za-z0-9_-]{24,}\Z", token)), len(token) < 20 or "/" in token or "." in token),  # regular expression
        vote(name in SECRET_NAMES or token.startswith(KEY_PREFIXES), name in HARMLESS_NAMES),  # gazetteer
        vote(bool(SECRET_NAMES.intersection(near)), bool(HARMLESS_NAMES.intersection(near))),  # context
        vote(bool(name), not name and before[-1:].isspace()),  # context: an assignment
        vote(h >= 3.2, h < 2.6),  # how random it is
        vote(0 < letters < len(token) and kinds >= 8, letters == 0 or kinds < 5),  # what it is made of
        vote(wordless and len(token) >= 16, not wordless),  # whether parts of it read like words
    )
    return "secret" + "".join(votes) + f"{min(4, len(token) // 12)}{min(4, int(h))}"


def number_votes(text: str, a: int, b: int) -> str:
    token, before = text[a:b], text[max(0, a - CONTEXT) : a]
    near = [w.lower() for w in WORD_BEFORE.findall(before)][-NEAR:]
    n, d = len(digits_of(token)), digits_of(token)
    votes = (
        vote(bool(PHONE_SHAPE.match(token)), n < 9 or n > 15),
        vote(bool(IDENTITY_SHAPE.match(token)), token.count(".") == 1),
        vote(bool(NUMBER_WORDS.intersection(near)), not near),
        vote(len(set(d)) >= 5, len(set(d)) <= 2),
        vote(False, text[b : b + 1] in ("%", "$", "€") or 14 <= n <= 19),  # an amount, or the length of a card number without its check digit
    )
    return "number" + "".join(votes) + f"{min(9, n // 2)}{int(any(c in token for c in ' -()'))}"


def numbers(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Each telephone and identity shape of a stretch, and what of seven digits or more is left between them."""
    at = a
    for m in [*NUMBER.finditer(text, a, b), None]:
        start, end = at, m.start() if m else b
        while start < end and not text[start].isdigit() and text[start] not in "+(":
            start += 1
        while end > start and not text[end - 1].isdigit():
            end -= 1
        if len(digits_of(text[start:end])) >= 7:
            yield start, end
        if m:
            yield m.span()
            at = m.end()


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens that may be secrets though no digit says so: assigned to a listed name, or long and of mixed case."""
    for m in SIGN.finditer(text):
        token = TOKEN.match(text, m.end())
        if token and assigned_name(text[max(0, m.end() - CONTEXT) : m.end()]) in SECRET_NAMES | HARMLESS_NAMES:
            end = m.end() + len(token.group().rstrip(".-/+"))
            if end - m.end() >= ASSIGNED and any(c.isalpha() for c in text[m.end() : end]):
                yield m.end(), end
    for m in LONG.finditer(text):
        own = m.group().rstrip(".-/+")
        if len(own) >= MIXED and any(c.isupper() for c in own[1:]) and any(c.islower() for c in own):
            yield m.start(), m.start() + len(own)


def candidates(text: str, islands: list[tuple[int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """Candidates (kind, start, end, votes), outside base spans and each other: those around digits first, then other tokens."""
    out, done, k = [], 0, 0
    for a, b in islands:
        if b <= done:
            continue
        a = max(a, done)
        lo = a
        while lo > done and text[lo - 1] in TOKEN_CHARS:
            lo -= 1
        hi = a
        while hi < len(text) and text[hi] in TOKEN_CHARS:
            hi += 1
        while hi > a + 1 and text[hi - 1] in ".-/+":
            hi -= 1
        while k < len(taken) and taken[k][2] <= lo:
            k += 1
        inside, j = [], k
        while j < len(taken) and taken[j][1] < max(hi, b):
            inside.append(taken[j][1:])
            j += 1
        letters = any(c.isalpha() for c in text[lo:hi])
        if letters and hi - lo >= WITH_DIGITS and not any(x < hi and y > lo for x, y in inside):
            out.append(("secret", lo, hi, secret_votes(text, lo, hi)))
            done = hi
        at = hi if letters else a - 1 if a > done and text[a - 1] == "(" else a
        for x, y in [*inside, (b, b)]:  # base spans by start
            for start, end in numbers(text, at, min(x, b)) if at < min(x, b) else ():
                out.append(("number", start, end, number_votes(text, start, end)))
                done = end
            at = max(at, y)
    used = sorted([*((a, b) for _, a, b, _ in out), *((a, b) for _, a, b in taken)])
    starts, done = [a for a, _ in used], 0
    ends = list(accumulate((b for _, b in used), max))
    for a, b in sorted(tokens(text)):
        i = bisect_left(starts, b)
        if a >= done and not (i and ends[i - 1] > a):
            out.append(("secret", a, b, secret_votes(text, a, b)))
            done = b
    return sorted(out, key=lambda c: c[1])


SCHEMA = "doc_id long, base array<struct<kind:string,start:long,end:long>>, candidates array<struct<kind:string,start:long,end:long,votes:string>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and candidates with their votes for every row of ``docs``; positions in code points."""
    span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    types = [pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("votes", pa.string())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, more = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                islands = [m.span() for m in ISLAND.finditer(text)]
                own = base_spans(text, islands)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                more.append([{"kind": k, "start": a, "end": b, "votes": v} for k, a, b, v in candidates(text, islands, own)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip((base, more), types))], names=["doc_id", "base", "candidates"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(map_batches, run, SCHEMA)


# --- expectation-maximisation and the classifier -----------------------------


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Probability of each vote pattern to be personal data.

    Labelers vote independently given the truth; an abstention says nothing.
    The start is the majority of votes.
    """
    votes = np.array([[{"+": 1, "0": 0, "-": -1}[c] for c in p] for p in patterns])
    p = np.clip(0.5 + 0.4 * np.sign(votes.sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        w1, w0 = counts * p, counts * (1 - p)
        prior = np.clip((w1.sum() + 1) / (counts.sum() + 2), 0.02, 0.98)
        z = np.full(len(p), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            for v in (1, -1):
                hit, cast = votes[:, j] == v, votes[:, j] != 0
                # a labeler is taken to be right more often than not: two good votes are added to what is counted
                yes = (w1[hit].sum() + (2 if v == 1 else 0.5)) / (w1[cast].sum() + 2.5)
                no = (w0[hit].sum() + (2 if v == -1 else 0.5)) / (w0[cast].sum() + 2.5)
                z[hit] += np.log(yes / no)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p


def train(counts: dict[str, int], votes: dict[str, int]) -> list[str]:
    """The candidates' keys (kind, votes, shape) that the span classifier accepts."""
    accepted = []
    for kind, n in votes.items():
        own = sorted((k, c) for k, c in counts.items() if k.startswith(kind))
        if not own:
            continue
        keys = [k[len(kind) :] for k, _ in own]
        count = np.array([c for _, c in own], dtype=float)
        truth = estimate([k[:n] for k in keys], count)
        columns = sorted({(i, c) for k in keys for i, c in enumerate(k)})
        x = np.array([[float(k[i] == c) for i, c in columns] + [1.0] for k in keys])
        w, weight = np.zeros(x.shape[1]), np.log1p(count)
        for _ in range(500):  # logistic regression with a small ridge
            r = weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - truth)
            w -= 2.0 / (weight.sum() * 4) * (x.T @ r + 0.01 * w)
        accepted += [k for (k, _), z in zip(own, x @ w) if z >= 0]
    return accepted


def detect(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, base spans and all spans, as arrays of (kind, start, end).

    Spans are ordered by start, then kind.  A null text counts as empty and has
    no spans; texts are searched whole, however long.  A candidate that the
    classifier finds as likely as not is a span.  Repeated rows give repeated
    results (and count as often), rows without an id keep a null id, an empty
    table gives an empty result, and other columns are ignored, whatever their
    names.
    """
    found = materialise(find(docs, **options), "pii-spans")
    counted = found.select(F.explode("candidates.votes").alias("votes")).groupBy("votes").count().collect()  # bounded by the vote patterns
    accepted = train({r["votes"]: r["count"] for r in counted}, {"number": 5, "secret": 7})
    spans = F.col("base")
    if accepted:
        more = F.transform(F.filter("candidates", lambda c: c["votes"].isin(*accepted)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        order = lambda s: F.struct(s["start"], F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["end"], s["kind"].alias("kind"))
        spans = F.transform(F.array_sort(F.transform(F.concat("base", more), order)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", "base", spans.alias("spans"))


def joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and listing of :func:`detect`."""
    def count(spans: str, kind: str) -> Column:
        kinds = F.transform(spans, lambda s: s["kind"])
        return (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")

    base, more = [count("base", k) for k in BASE_KINDS], [count("spans", k) for k in KINDS if k not in BASE_KINDS]
    return detect(docs).select("doc_id", *base, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), *more, F.size("spans").cast("long").alias("n_spans"))
