"""Slow and plain versions of what the operators compute, from their definitions."""

import hashlib
import re
import zlib


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, (name, pattern) in enumerate(zip(("email", "ip", "card", "phone"), patterns)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if name == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if name == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def fingerprint(text, shingle=3):
    import xxhash

    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    count = [0] * 64
    for p in parts:
        h = xxhash.xxh64(p.encode(), seed=42).intdigest()
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(parts))


def roots(items, linked):
    """Smallest item that links reach, by comparing all pairs."""
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in items:
        for j in items:
            if i < j and linked(i, j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in items}


def repeated_bytes(texts, length=100):
    """For each (place, text) in order of place: bytes, removed bytes, spans, digest of the rest."""
    seen, out = {}, {}
    for place, text in sorted(texts.items()):
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen.setdefault(b[i : i + length], (place, i)) != (place, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[place] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
