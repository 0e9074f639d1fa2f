"""Removal of repeated substrings by a hash-compared suffix sort.

Every string of ``LENGTH`` bytes (a window) that also starts earlier is found,
over all documents, and the bytes it covers are removed.

1. Anchors.  The gram of ``GRAM`` bytes with the smallest hash among those of a
   window is the window's anchor; equal windows have equal anchors.  Windows in
   a row with the same anchor form a segment, so a document's windows fall into
   few segments.  Hashes are differences of prefix polynomial hashes.
2. Segments that are equal as a whole repeat as a whole: all but the earliest
   are decided.  A task compares those that it has itself by the prefix hashes
   and verifies what it finds on the bytes.  What it passes on carries a 128-bit
   BLAKE2b digest of its bytes, by which those of different tasks are told apart.
3. Where a gram has segments that differ, the bytes of the earliest of each go
   to one place.  Their suffixes from the gram on, and their prefixes before it
   read backwards, are sorted.  Comparisons find the common extension of two
   suffixes by binary search over prefix polynomial hashes, so they take
   logarithmically many steps, and verify what they find on the bytes.  Python's
   sort, a mergesort, does the rest.  Two windows are equal if the suffixes and
   prefixes around their gram agree far enough, and the earliest of equal
   windows stays.

Skew.  A task passes on one segment of each kind, so a passage that a third of
all documents hold meets once for each task.  Grams with many different
segments in a task (a short phrase in many contexts) are salted; what is left
of their windows is combined by the window's bytes.  The same happens to a
gram's segments beyond ``CHUNK``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, materialise, slices, utf8

LENGTH, GRAM = 100, 20
GRAMS = LENGTH - GRAM + 1
#: Anchors that a task compares at once, segments of one gram there beyond which it is salted, and the number of salts.
TASK_ANCHORS, LOCALLY_HOT, SALTS = 2_000_000, 64, 256
#: Segments sorted at once.
CHUNK = 4000
#: Odd multipliers of the two polynomial hashes modulo 2**64, and of the mixing step.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = 0xD6E8FEB86659FD93
FULL = (1 << 64) - 1
PLAIN, DONE, MARKER, SALTED = range(4)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of a base modulo 2**64 and their inverses, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            grow = lambda b: np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(size - 1, b, dtype=np.uint64))))
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


POWERS = tuple(Powers(b) for b in BASES)


def prefix_hashes(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums S and inverse powers D: (S[j] - S[i]) * D[i] is the hash of data[i:j], wherever that stands."""
    up, down = POWERS[which].upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def segments(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of texts that stand one after another in ``data``: number of the text, gram hash, segment hash, first window, number of windows, gram's offset from it."""
    empty = tuple(np.empty(0, dtype=np.int64) for _ in range(6))
    if len(data) < LENGTH:
        return empty
    ends = np.cumsum(sizes)
    valid = np.ones(len(data) - LENGTH + 1, dtype=bool)
    for e, n in zip(ends.tolist(), sizes.tolist()):  # windows that would reach beyond their text
        valid[max(e - n, e - LENGTH + 1) : e] = False
    windows = np.flatnonzero(valid)
    if not len(windows):
        return empty
    sums, down = prefix_hashes(data, 0)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(order, GRAMS) & np.uint64(0xFFFFFFFF)).astype(np.int64)[windows]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1))))
    first, gram = windows[new], at[new]
    count = np.diff(np.concatenate((new, [len(windows)])))
    text = np.searchsorted(ends, first, "right")
    stop = first + count + LENGTH - 1
    sums2, down2 = prefix_hashes(data, 1)
    whole = mixed((sums2[stop] - sums2[first]) * down2[first]) ^ mixed((sums[stop] - sums[first]) * down[first] + np.uint64(7)) + count.astype(np.uint64)
    return text, (grams[gram] >> np.uint64(24)).astype(np.int64), whole.view(np.int64), first - (ends - sizes)[text], count, gram - first


def pack(first, offset, count, flag):
    return first << 18 | offset << 10 | count << 2 | flag


def unpack(x):
    return x >> 18, x >> 10 & 255, x >> 2 & 255, x & 3


def find(batches: Iterator[pa.RecordBatch], locally_hot: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, tag, text) to segments (gram, high, low, doc, tag, packed), one of each kind from a task; high and low are the digest."""
    held: list[tuple[np.ndarray, ...]] = []
    texts: list[bytes] = []  # of the segments held; what Spark gives a task at most
    size = base = 0

    def flush() -> Iterator[pa.RecordBatch]:
        gram, whole, doc, tag, first, count, offset, start = (np.concatenate(x) for x in zip(*held))
        data = b"".join(texts)
        held.clear()
        texts.clear()
        o = np.lexsort((first, tag, doc, whole, gram))
        gram, whole, doc, tag, first, count, offset, start = (x[o] for x in (gram, whole, doc, tag, first, count, offset, start))
        again = np.zeros(len(gram), dtype=bool)
        again[1:] = (gram[1:] == gram[:-1]) & (whole[1:] == whole[:-1])
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(gram))))
        stop = start + count + LENGTH - 1
        for i, k in zip(np.flatnonzero(again).tolist(), lead[again].tolist()):  # whatever the hashes say, the bytes decide
            if data[start[i] : stop[i]] != data[start[k] : stop[k]]:
                again[i] = False
        lead = np.where(again, lead, np.arange(len(gram)))
        done = again & ((doc != doc[lead]) | (tag != tag[lead]) | (first != first[lead]))
        same = again & ~done  # a repeated row
        flag = np.where(done, DONE, PLAIN)
        live = np.flatnonzero(~again)
        digest = np.zeros((len(gram), 2), dtype=np.int64)
        blake = hashlib.blake2b
        digest[live] = np.frombuffer(b"".join([blake(data[a:b], digest_size=16).digest() for a, b in zip(start[live].tolist(), stop[live].tolist())]), dtype=np.int64).reshape(-1, 2)
        kinds, inverse, number = np.unique(gram[live], return_inverse=True, return_counts=True)
        hot = np.zeros(len(gram), dtype=bool)
        hot[live] = (number > locally_hot)[inverse]
        flag[hot] = SALTED
        route = gram.copy()
        salt = mixed(gram[hot].astype(np.uint64) * np.uint64(SALTS + 1) + (digest[hot, 0].view(np.uint64) % np.uint64(SALTS)) + np.uint64(1))
        route[hot] = (salt >> np.uint64(24)).astype(np.int64)
        route[done] = (mixed(doc[done].view(np.uint64)) >> np.uint64(24)).astype(np.int64)
        marks = kinds[number > locally_hot]
        keep, none = ~same, np.zeros_like(marks)
        cols = [np.concatenate((x[keep], m)) for x, m in ((route, marks), (digest[:, 0], none), (digest[:, 1], none), (doc, none), (tag, none), (pack(first, offset, count, flag), np.full_like(marks, MARKER)))]
        for i in range(0, len(cols[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in cols], names=["gram", "high", "low", "doc", "tag", "packed"])

    for batch in slices(batches, limit=1 << 20):
        own = utf8(batch.column("text"))
        joined, sizes = b"".join(own), np.array([len(t) for t in own])
        text, gram, whole, first, count, offset = segments(np.frombuffer(joined, dtype=np.uint8), sizes)
        doc, tag = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc", "tag"))
        if len(gram):
            held.append((gram, whole, doc, tag, first, count, offset, first + (np.cumsum(sizes) - sizes)[text] + base))
            texts.append(joined)
            size += len(gram)
            base += len(joined)
        if size >= TASK_ANCHORS:
            yield from flush()
            size = base = 0
    if held:
        yield from flush()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows that are sorted by ``key``, cut so that none of its values stands in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.concat_batches(held)
            held = []
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by gram, digest and place: those that repeat one before (fine 0), those to be sorted (1, salted or marked 2)."""
    for batch in whole_groups(batches, "gram"):
        gram, high, low, doc, tag, packed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "high", "low", "doc", "tag", "packed"))
        flag = packed & 3
        out = [(np.zeros(int((flag == DONE).sum()), np.int64), flag == DONE)]
        marked = np.unique(gram[flag == MARKER])
        live = np.flatnonzero((flag == PLAIN) | (flag == SALTED))
        g, w, v, d, t, p = (x[live] for x in (gram, high, low, doc, tag, packed))
        if len(live):
            new_g = np.concatenate(([True], g[1:] != g[:-1]))
            new = new_g | np.concatenate(([True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            repeat = ~new & ((d != d[lead]) | (t != t[lead]) | (p >> 2 != p[lead] >> 2))
            kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_g))[np.cumsum(new_g) - 1]
            hot = np.isin(g, marked) | (flag[live] == SALTED)
            fine = np.where(repeat, 0, np.where(hot, 2, 1))
            take = repeat | (new & ((kinds > 1) | hot))
            out.append((fine[take], live[take]))
        for kind, rows in out:
            if len(kind):
                yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x[rows]) for x in (gram, doc, tag, packed))], names=["fine", "gram", "doc", "tag", "packed"])


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their segments to be sorted: the segments' bytes."""
    for batch in slices(batches):
        rows: list[tuple] = []
        for doc, tag, text, own in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("own").to_pylist()):
            for s in own:
                first, _, count, _ = unpack(s["packed"])
                rows.append((s["gram"], s["fine"], doc, tag, s["packed"], text[first : first + count + LENGTH - 1]))
        if rows:
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["gram", "fine", "doc", "tag", "packed", "bytes"])


class Suffixes:
    """Strings in one buffer with prefix polynomial hashes."""

    def __init__(self, strings: list[bytes]):
        self.data = b"".join(strings)
        sizes = [len(s) for s in strings]
        self.start = np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist()
        self.size = sizes
        sums, down = prefix_hashes(np.frombuffer(self.data, dtype=np.uint8), 0)
        self.sums, self.down = sums.tolist(), down.tolist()

    def common(self, x: int, y: int) -> int:
        """The length of the longest common prefix of strings x and y, by binary search over hashes, verified on the bytes."""
        i, j = self.start[x], self.start[y]
        low, high = 0, min(self.size[x], self.size[y])
        sums, di, dj = self.sums, self.down[i], self.down[j]
        si, sj = sums[i], sums[j]
        while low < high:
            mid = (low + high + 1) >> 1
            if ((sums[i + mid] - si) * di - (sums[j + mid] - sj) * dj) & FULL:
                high = mid - 1
            else:
                low = mid
        data = self.data
        if data[i : i + low] != data[j : j + low]:  # hashes collided
            low = next(k for k in range(low) if data[i + k] != data[j + k])
        return low

    def compare(self, x: int, y: int) -> int:
        n = self.common(x, y)
        i, j = self.start[x] + n, self.start[y] + n
        if n == self.size[x] or n == self.size[y]:
            return self.size[x] - self.size[y]
        return self.data[i] - self.data[j]

    def ordered(self, members: list[int]) -> tuple[list[int], list[int]]:
        """Members in suffix order, and what each has in common with the one before it."""
        order = sorted(members, key=cmp_to_key(self.compare))
        return order, [0, *(self.common(x, y) for x, y in zip(order, order[1:]))]


def repeated(members: list[int], after: Suffixes, before: Suffixes, offsets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows (member, gram's offset in it) of segments of one gram that an earlier member holds too; members by place."""
    if len(members) == 2:
        x, y = members
        right, left = after.common(x, y), before.common(x, y)
        low, high = offsets[y]
        return [(y, o) for o in range(max(low, LENGTH - right), min(high, left) + 1)]
    right, left = after.ordered(members), before.ordered(members)
    out = []
    for o in range(min(offsets[m][0] for m in members), max(offsets[m][1] for m in members) + 1):
        classes: dict[int, int] = {}
        for (order, common), depth, weight in ((right, LENGTH - o, 1), (left, o, len(members) + 1)):
            kind = 0
            for k, m in enumerate(order):
                if common[k] < depth:
                    kind = k
                classes[m] = classes.get(m, 0) + weight * kind
        seen = set()
        for m in members:
            if offsets[m][0] <= o <= offsets[m][1]:
                if classes[m] in seen:
                    out.append((m, o))
                seen.add(classes[m])
    return out


def sort_segments(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Segments by gram and place: stretches of repeated windows (doc, tag, first, n), and single windows that other places may hold too."""

    def chunks() -> Iterator[tuple[list[dict], bool]]:
        """Whole grams, about ``chunk`` segments at once; a gram beyond that in parts."""
        held: list[dict] = []
        begin = 0  # of the last gram in held
        broken = False
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["gram"] != held[-1]["gram"]:
                    if broken:
                        yield held, True
                        held, broken = [], False
                    begin = len(held)
                held.append(row)
                if len(held) > chunk:
                    if begin:
                        yield held[:begin], False
                        held, begin = held[begin:], 0
                    else:
                        yield held, True
                        held, broken = [], True
        if held:
            yield held, broken

    for rows, broken in chunks():
        parts = [unpack(r["packed"]) for r in rows]
        offsets = [(offset - count + 1, offset) for _, offset, count, _ in parts]
        after = Suffixes([r["bytes"][p[1] :] for r, p in zip(rows, parts)])
        before = Suffixes([r["bytes"][: p[1]][::-1] for r, p in zip(rows, parts)])
        out: list[tuple] = []
        i = 0
        while i < len(rows):
            j = i
            members: list[int] = []
            while j < len(rows) and rows[j]["gram"] == rows[i]["gram"]:
                if j == i or any(rows[j][c] != rows[j - 1][c] for c in ("doc", "tag", "packed")):  # else a repeated row
                    members.append(j)
                j += 1
            members.sort(key=lambda m: (rows[m]["doc"], rows[m]["tag"], parts[m][0] + parts[m][1]))
            found = repeated(members, after, before, offsets) if len(members) > 1 else []
            for m, o in found:
                out.append((rows[m]["doc"], rows[m]["tag"], parts[m][0] + parts[m][1] - o, 1, None))
            if broken or any(rows[m]["fine"] == 2 for m in members):
                gone = set(found)
                for m in members:
                    for o in range(offsets[m][0], offsets[m][1] + 1):
                        if (m, o) not in gone:
                            k = parts[m][1] - o
                            out.append((rows[m]["doc"], rows[m]["tag"], parts[m][0] + k, 1, rows[m]["bytes"][k : k + LENGTH]))
            i = j
        plain = sorted(x for x in out if x[4] is None)
        merged: list[list] = []
        for doc, tag, first, n, _ in plain:
            if merged and merged[-1][:2] == [doc, tag] and merged[-1][2] + merged[-1][3] == first:
                merged[-1][3] += 1
            else:
                merged.append([doc, tag, first, n, None])
        merged += [list(x) for x in out if x[4] is not None]
        if merged:
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*merged), kinds)], names=["doc", "tag", "first", "n", "window"])


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with stretches of repeated windows: what is left."""
    for batch in slices(batches):
        rows = []
        for text, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("own").to_pylist()):
            if not own:
                rows.append((len(text), 0, 0, text))
                continue
            turn = np.zeros(len(text) + 1, dtype=np.int32)
            np.add.at(turn, [s["first"] for s in own], 1)
            np.add.at(turn, [s["first"] + s["n"] + LENGTH - 1 for s in own], -1)
            gone = np.cumsum(turn[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((len(text), int(gone.sum()), spans, np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()))
        kinds = [pa.int64()] * 3 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", locally_hot: int = LOCALLY_HOT, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and kept, the bytes that stay.

    A null text counts as empty.  Places are ordered by id, then by a hash of
    the text (for rows that share an id), then by position; rows without an id
    come last.  A row that repeats another in id and text is the same place and
    gets the same result.  Texts under ``LENGTH`` bytes keep all their bytes;
    others are taken whole, however long.  An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.col(id_col).cast("long")
    unique = docs.groupBy(own.alias("own")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    last = (1 << 63) - 1
    placed = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(last)).alias("doc"), (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("tag"), text.alias("text"))

    found = placed.select("doc", "tag", "text").transform(map_batches, lambda it: find(it, locally_hot), "gram long, high long, low long, doc long, tag long, packed long")
    decided = materialise(found.repartition("gram").sortWithinPartitions("gram", "high", "low", "doc", "tag", "packed").transform(map_batches, decide, "fine long, gram long, doc long, tag long, packed long"), "substring-segments")

    needed = decided.filter("fine > 0").groupBy("doc", "tag").agg(F.collect_list(F.struct("gram", "fine", "packed")).alias("own"))
    cut = placed.select("doc", "tag", "text").join(needed, ["doc", "tag"]).transform(map_batches, cut_out, "gram long, fine long, doc long, tag long, packed long, bytes binary")
    sorted_ = materialise(cut.repartition("gram").sortWithinPartitions("gram", "doc", "tag", "packed").transform(map_batches, lambda it: sort_segments(it, chunk), "doc long, tag long, first long, n long, window binary"), "substring-windows")

    place = F.struct("doc", "tag", "first")
    split = sorted_.filter("window IS NOT NULL").withColumn("earliest", F.min(place).over(Window.partitionBy("window"))).filter(place != F.col("earliest")).select("doc", "tag", "first", "n")
    whole = decided.filter("fine = 0").select("doc", "tag", F.shiftright("packed", 18).alias("first"), F.shiftright("packed", 2).bitwiseAND(F.lit(255)).cast("long").alias("n"))
    gone = whole.unionByName(sorted_.filter("window IS NULL").select("doc", "tag", "first", "n")).unionByName(split)
    gone = gone.groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "n")).alias("own"))
    return placed.join(gone, ["doc", "tag"], "left").select("doc_id", "text", "own").transform(map_batches, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def substring_digest(docs: DataFrame) -> DataFrame:
    """Counts of :func:`dedup_substrings` and the digest of what it keeps."""
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
