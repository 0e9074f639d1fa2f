"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components.

Fingerprints that differ in at most ``bits`` bits agree on all but ``bits`` of
the blocks that the 64 bits are split into.  For each choice of the blocks that
agree there is a table keyed by their bits; close pairs share a key in some
table, and every pair found there is verified.

Only distinct fingerprints enter, so copies cost nothing.  A key that more than
``WIDE`` of them share isn't compared as a group: they agree on the key's bits,
so the bits left are split in parts, close pairs agree on all but ``bits`` of
those too, and they are keyed again, until few bits are left.  With 3 bits this
leaves at most 9 free bits, hence at most 512 fingerprints in a group, however
many there are.  Within a group, links are reduced to a spanning tree of each
connected part, so what is emitted is linear in the group.

:func:`near_duplicates` links by the fingerprints alone.  :func:`keep_one` also
links texts whose fingerprints are farther apart if their shingles prove similar
enough.  Those candidates come from MinHash bands over the texts' own shingle
sets: a pair with a similarity of 0.8 shares a band with a probability of
0.999997, more similar ones with a higher one.  A band's group is first tried
along stars; where that leaves it apart, all its sets are compared in the task
that holds it, which passes on links alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, settled, slices, utf8

BITS = 3
WIDE = 4096
#: Keys with at most so many free bits aren't split further.
FEW_BITS = 13
#: Groups up to this size are compared shift by shift over a whole batch.
SMALL = 16
SEED = 42
#: Groups up to this size are compared by their shingle sets in one task, in matrices of so many columns.
WIDE_SETS, COLUMNS = 4096, 1024
#: MinHash bands of a shingle set, and hashes in each.
BANDS, ROWS = 24, 4
FACTORS = np.random.default_rng(SEED).integers(1 << 31, dtype=np.uint32, size=BANDS * ROWS) * np.uint32(2) + np.uint32(1)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits: each is 1 if it is set in over half the hashes of the shingles; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space
    n = len(words) - shingle + 1
    if n > 1:
        rows = [words[i : i + n] for i in range(shingle)]
        parts = list(map(b" ".join, zip(*rows)))
    elif words:
        parts, n = [b" ".join(words)], 1
    else:
        return 0
    hash_of = xxhash.xxh64_intdigest
    h = np.array([hash_of(p, SEED) for p in parts], dtype=">u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 255):
        count += bits[i : i + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def tag_of(text_col: str) -> Column:
    """What tells texts apart where rows are meant and not ids."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similar_shingle: int = 0) -> DataFrame:
    """doc_id, tag (a hash of the text) and fp, the fingerprint as a signed long, of every row of ``docs``.

    With ``similar_shingle`` also n, the size of the set of shingles of so many
    words, and its MinHash signature.
    """
    wide = similar_shingle > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            cols, names = [batch.column("doc_id"), batch.column("tag"), pa.array(fp.view(np.int64))], ["doc_id", "tag", "fp"]
            if wide:
                sets = [shingle_set(t, similar_shingle) for t in texts]
                cols += [pa.array([len(x) for x in sets], pa.int64()), pa.array([signature(x).tobytes() for x in sets], pa.binary())]
                names += ["n", "signature"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tag_of(text_col).alias("tag"), F.col(text_col).alias("text"))
    return rows.transform(map_batches, run, "doc_id long, tag long, fp long" + ", n long, signature binary" * wide)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted; fewer words are one shingle."""
    w = text.lower().split()
    rows = [w[i : len(w) - shingle + 1 + i] for i in range(shingle)]
    parts = list(map(b" ".join, zip(*rows))) if len(w) > shingle else [b" ".join(w)]
    return np.unique(np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], dtype=np.uint64))


def signature(own: np.ndarray) -> np.ndarray:
    """The MinHash values of a shingle set."""
    x = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 512):
        low = np.minimum(low, np.multiply.outer(FACTORS, x[i : i + 512]).min(1))
    return low


def band_keys() -> Column:
    """A key for each band of a signature."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring("signature", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)])


def split_mask(mask: int, parts: int) -> list[int]:
    """The bits of ``mask`` in ``parts`` masks of nearly equal size."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def choices(mask: int, parts: int, differ: int) -> list[int]:
    """For each way in which ``differ`` parts of ``mask`` may differ, the mask of those that agree."""
    return [sum(c) for c in combinations(split_mask(mask, parts), parts - differ)]


def blocks_for(bits: int) -> int:
    """Blocks of the tables: 3 agree, or for few bits as many as differ; keys have 21 bits or more."""
    return bits + 3


def parts_for(bits: int) -> int:
    """The most parts with at most 200 ways in which ``bits`` of them differ."""
    return max(p for p in range(bits + 1, 30) if comb(p, bits) <= 200)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tree(ids: np.ndarray, fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Close pairs that span each connected part of a group."""
    out, left = [], np.arange(len(ids))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            by = np.full(len(left), -1)
            for i in range(0, len(front), 64):
                near = np.bitwise_count(fps[front[i : i + 64], None] ^ fps[left][None]) <= bits
                hit = near.any(0) & (by < 0)
                by[hit] = front[i : i + 64][near.argmax(0)[hit]]
            found = by >= 0
            out += zip(ids[by[found]].tolist(), ids[left[found]].tolist())
            front, left = left[found], left[~found]
    return [(min(e), max(e)) for e in out]


def pairs_in_groups(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, bits: int) -> list[np.ndarray]:
    """Edges (smaller id, larger id) among rows that are sorted by key; whole groups."""
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((start, [len(keys)])))
    edges = []
    small = np.repeat(size, size)
    for shift in range(1, int(min(SMALL, size.max(initial=1)))):
        at = np.flatnonzero((keys[shift:] == keys[:-shift]) & (small[shift:] <= SMALL))
        at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= bits]
        edges.append(np.column_stack((np.minimum(ids[at], ids[at + shift]), np.maximum(ids[at], ids[at + shift]))))
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        found = tree(ids[s : s + n], fps[s : s + n], bits)
        edges.append(np.array(found, dtype=np.int64).reshape(-1, 2))
    return edges


def whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns of rows that are sorted by the first; never part of a group."""
    held: list[list[np.ndarray]] = []  # the rows of the last key so far
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if held and now[0][-1] == held[-1][0][-1]:
            held.append(now)
            continue
        now = [np.concatenate(x) for x in zip(*held, now)]
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        if last:
            yield [x[:last] for x in now]
        held = [[x[last:] for x in now]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def link(bits: int):
    """Over rows (key, id, fp) sorted by key: verified edges (a, b), a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, fps in whole_groups(batches, ("key", "id", "fp")):
            edges = [e for e in pairs_in_groups(keys, ids, fps.view(np.uint64), bits) if len(e)]
            if edges:
                both = np.unique(np.concatenate(edges), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def batch_of_pairs(ids: np.ndarray, fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Pairs of rows as (a, fa, b, fb), the smaller id first."""
    i, j = np.where(ids[i] <= ids[j], i, j), np.where(ids[i] <= ids[j], j, i)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], fps[i], ids[j], fps[j])], names=["a", "fa", "b", "fb"])


def unlinked(bits: int, similarity: float, turn: int = 0):
    """Over rows (key, id, fp, n, label) sorted by key: pairs of other labels that may be similar.

    All pairs of groups of up to ``SMALL`` rows, and in larger ones those with
    one member, another for each key and turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, fps, n, label in whole_groups(batches, ("key", "id", "fp", "n", "label")):
            bits_of = fps.view(np.uint64)
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.concatenate((start, [len(keys)])))
            of = np.repeat(size, size)
            left, right = [], []
            for shift in range(1, int(min(SMALL, size.max()))):
                at = np.flatnonzero((keys[shift:] == keys[:-shift]) & (of[shift:] <= SMALL))
                left.append(at)
                right.append(at + shift)
            for s, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
                own = np.arange(s, s + m)
                x = (ids[own] ^ keys[own]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
                left.append(np.full(m, own[(x ^ (x >> np.uint64(32))).argmin()]))
                right.append(own)
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                ok = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])) & (np.bitwise_count(bits_of[i] ^ bits_of[j]) <= bits)
                yield batch_of_pairs(ids, fps, i[ok], j[ok])

    return run


def forest(pairs: np.ndarray, labels: np.ndarray) -> list[int]:
    """Which of the pairs (rows i, j), taken in order, join labels that those before leave apart."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for k, (i, j) in enumerate(pairs.tolist()):
        a, b = find(int(labels[i])), find(int(labels[j]))
        if a != b:
            parent[a] = b
            out.append(k)
    return out


def verified(bits: int, similarity: float):
    """Over rows (key, fp, label, set) sorted by key: links (a, b) of fingerprints that join the labels of each group as all its similar pairs do.

    All pairs of a group are compared where it stands, by products of its
    incidence matrix, so nothing is passed on but links that are proven and join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps, label, held in whole_groups(batches, ("key", "fp", "label", "set")):
            bits_of = fps.view(np.uint64)
            start = [*np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist(), len(keys)]
            for s, e in zip(start, start[1:]):
                sets = [np.frombuffer(x, dtype=np.uint64) for x in held[s:e]]
                n = np.array([len(x) for x in sets])
                _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                row = np.repeat(np.arange(e - s), n)
                often = count[column] > 1  # the others are in no intersection
                row, column = row[often], (np.cumsum(count > 1) - 1)[column[often]]
                shared = np.zeros((e - s, e - s), dtype=np.float32)
                for c in range(0, int((count > 1).sum()), COLUMNS):
                    own = (column >= c) & (column < c + COLUMNS)
                    held_here = np.zeros((e - s, COLUMNS), dtype=np.float32)
                    held_here[row[own], column[own] - c] = 1
                    shared += held_here @ held_here.T
                found = []
                for i in range(0, e - s, 256):
                    part = shared[i : i + 256]
                    like = (part >= similarity * (n[i : i + 256, None] + n[None] - part)) & (label[s + i : min(s + i + 256, e), None] != label[None, s:e])
                    found.append(np.argwhere(np.triu(like, i + 1)) + [i, 0])
                pairs = np.concatenate(found)
                pairs = pairs[np.bitwise_count(bits_of[s + pairs[:, 0]] ^ bits_of[s + pairs[:, 1]]) <= bits]
                kept = s + pairs[forest(pairs, label[s:e])]
                if len(kept):
                    yield pa.RecordBatch.from_arrays([pa.array(fps[kept].min(1)), pa.array(fps[kept].max(1))], names=["a", "b"])

    return run


def edges_of(reps: DataFrame, bits: int = BITS, wide: int = WIDE) -> DataFrame:
    """Verified links (a, b), a < b, that connect all rows (id, fp) of ``reps`` within ``bits``."""
    masks = choices((1 << 64) - 1, blocks_for(bits), bits)
    tables = F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.xxhash64(F.lit(signed(m)), F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("key")) for m in masks])
    keyed = reps.select("id", "fp", F.explode(tables).alias("t")).select("t.mask", "t.key", "id", "fp")
    free = 64 - min(m.bit_count() for m in masks)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finer: dict[int, list[int]] = {}
        for batch in batches:
            mask, ids, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "id", "fp"))
            for known in np.unique(mask).tolist():
                own, bits_known = mask == known, known % (1 << 64)
                for more in finer.setdefault(known, choices((1 << 64) - 1 ^ bits_known, parts_for(bits), bits)):
                    m = np.uint64(bits_known | more)
                    x = (fps[own].view(np.uint64) & m) * np.uint64(0x9E3779B97F4A7C15) + m
                    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), signed(int(m)))), pa.array((x ^ (x >> np.uint64(32))).view(np.int64)), pa.array(ids[own]), pa.array(fps[own])], names=["mask", "key", "id", "fp"])

    parts = []
    while True:
        hot = materialise(keyed.groupBy("key").count().filter(F.col("count") > wide).select("key"), "simhash-hot")
        if free <= FEW_BITS or hot.isEmpty():
            parts.append(keyed)
            break
        parts.append(keyed.join(hot, "key", "left_anti"))
        keyed = materialise(keyed.join(hot, "key", "left_semi").transform(map_batches, refine, "mask long, key long, id long, fp long"), "simhash-finer")
        free = -(-free * bits // parts_for(bits))
    edges = None
    for part in parts:
        own = part.select("key", "id", "fp").repartition("key").sortWithinPartitions("key", "fp").transform(map_batches, link(bits), "a long, b long")
        edges = own if edges is None else edges.unionByName(own)
    return edges.distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame, shingle: int, text_col: str = "text") -> DataFrame:
    """id (a tag) and the shingle set of the texts whose tags are in ``ids``; lower case counts as upper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            sets = [shingle_set(text, shingle).tobytes() for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "set"])

    texts = docs.select(tag_of(text_col).alias("id"), F.col(text_col).alias("text")).join(ids.hint("merge"), "id", "left_semi")  # grows with the documents, so it's never broadcast
    return materialise(texts.transform(map_batches, run, "id long, set binary").distinct(), "simhash-shingles")


def similar(docs: DataFrame, pairs: DataFrame, similarity: float, shingle: int, text_col: str = "text") -> DataFrame:
    """Links (a, b) of the fingerprints of the pairs (a, fa, b, fb) of tags whose texts' sets of word shingles have a Jaccard similarity of at least ``similarity``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", 1 << 20):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("fa", "fb")], names=["fa", "fb"])

    sets = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), shingle, text_col)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    found = both.select("fa", "fb", "x", "y").transform(map_batches, compare, "fa long, fb long")
    return found.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root, the smallest node that edges (a, b) reach from it, for every node that isn't a root.

    Alternates small stars (each node's smaller neighbours move to the smallest
    of them) and large stars (its larger neighbours do), which ends in one star
    for each component after few rounds.  Each half of a round is a written
    table, and so are the smallest neighbours: the edges of a node with very
    many then meet their table in a join of two shuffles, which adaptive
    execution splits.
    """

    def lowest(edges: DataFrame) -> DataFrame:
        return materialise(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)

    stars = materialise(edges.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), name)
    before = None
    while True:
        low = lowest(stars)
        small = stars.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        small = materialise(small, name)
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = materialise(large, name)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def crowded(docs: DataFrame, texts: DataFrame, keyed: DataFrame, bits: int, similarity: float, shingle: int, text_col: str, wide: int) -> DataFrame:
    """Links (a, b) that :func:`verified` finds in the bands' groups of over ``SMALL`` rows that hold several labels.

    ``keyed`` has a row (key, id, fp, label) for each band of a text.  Groups of
    over ``wide`` rows are keyed again, with another band each, up to twice: a
    pair with a similarity of 0.8 shares three bands of 24 with a probability of
    0.9995, and more similar ones with a higher one.  What is wide even then is
    cut in blocks of ``wide / 2`` rows that meet two by two.
    """
    out, sets, small = None, None, SMALL
    for level in range(3):
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        rows = materialise(keyed.join(sizes.filter((F.col("m") > small) & (F.col("lo") < F.col("hi"))).select("key", "m"), "key"), "simhash-crowded")
        if sets is None:
            sets = shingle_sets(docs, rows.select("id").distinct(), shingle, text_col)
        now, more, last = rows.filter(F.col("m") <= wide), rows.filter(F.col("m") > wide), level == 2
        if last:
            blocks = F.ceil(2 * F.col("m") / wide).cast("int")
            own = F.pmod(F.xxhash64("id", "fp"), blocks).cast("int")
            other = F.explode(F.sequence(F.lit(0), blocks - 1))
            dealt = more.withColumn("own", own).withColumn("other", other).withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
            now = now.unionByName(dealt.select(*now.columns))
        found = now.select("key", "id", "fp", "label").join(sets, "id").select("key", "fp", "label", "set").repartition("key").sortWithinPartitions("key").transform(map_batches, verified(bits, similarity), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if last or more.isEmpty():
            break
        small = 1  # in what is keyed again no pairs were tried yet
        again = more.select("key", "id", "fp", "label").join(texts.select("id", "fp", band_keys().alias("bands")), ["id", "fp"])
        keyed = again.select("key", "id", "fp", "label", F.explode("bands").alias("band")).filter("band <> key").select(F.xxhash64("key", "band").alias("key"), "id", "fp", "label")
    return out.distinct()


def wider_links(docs: DataFrame, rows: DataFrame, edges: DataFrame, bits: int, similarity: float, shingle: int, text_col: str = "text", wide: int = WIDE_SETS, rounds: int = 1) -> DataFrame:
    """Links (a, b) of fingerprints within ``bits`` whose texts are similar, as far as ``edges`` don't join them yet.

    ``rows`` have fp, tag, n and signature.  First the stars of each band's
    group, ``rounds`` times, and all pairs of small ones; what they join needs no
    more comparison, so that a large group of near copies costs little.  Then
    the large groups that are still apart.
    """
    texts = materialise(rows.groupBy(F.col("tag").alias("id"), "fp").agg(F.first("n").alias("n"), F.first("signature").alias("signature")), "simhash-texts")
    bands = texts.select("id", "fp", "n", F.explode(band_keys()).alias("key"))
    links = before = None
    for turn in range(rounds + 1):
        roots = components(edges, "simhash-roots")
        labels = texts.select("fp").distinct().join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("label"))
        keyed = bands.join(labels, "fp").select("key", "id", "fp", "n", "label")
        if turn < rounds:
            pairs = keyed.repartition("key").sortWithinPartitions("key").transform(map_batches, unlinked(bits, similarity, turn), "a long, fa long, b long, fb long").distinct()
            if before is not None:
                pairs = pairs.join(before, ["a", "fa", "b", "fb"], "left_anti")
            pairs = materialise(pairs, "simhash-wider")
            before = pairs if before is None else before.unionByName(pairs)
            found = similar(docs, pairs, similarity, shingle, text_col)
        else:
            found = crowded(docs, texts, keyed.drop("n"), bits, similarity, shingle, text_col, wide)
        found = materialise(found, "simhash-similar")
        links = found if links is None else links.unionByName(found)
        edges = materialise(edges.unionByName(found).distinct(), "simhash-edges")
    return links


def _linked(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, wider_bits: int, similarity: float, similar_shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tag, fp), and the part (a fingerprint that stands for a component) of each fingerprint."""
    wider = wider_bits > bits
    rows = materialise(fingerprints(docs, id_col, text_col, shingle, similar_shingle if wider else 0), "simhash-rows")
    nodes = materialise(rows.select("fp").distinct().select(F.col("fp").alias("id"), "fp"), "simhash-nodes")
    edges = edges_of(nodes, bits)
    if wider:
        edges = materialise(edges, "simhash-edges")
        edges = edges.unionByName(wider_links(docs, rows, edges, wider_bits, similarity, similar_shingle, text_col)).distinct()
    roots = components(edges, "simhash-components")
    return rows, nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("part"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = BITS, wider_bits: int = 0, similarity: float = 0.8, similar_shingle: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint and component_id.

    Fingerprints that differ in at most ``bits`` bits link; component_id is the
    smallest id that links reach.  With ``wider_bits``, fingerprints up to that
    distance link too if the shingle sets of their texts, of
    ``similar_shingle`` words, have a Jaccard similarity of ``similarity``.

    A null text counts as empty: fingerprint 0, which links like any other.
    Whole texts count, however long.  Texts link, not ids: rows that repeat an
    id may stand in different components.  A row without an id links too; it
    takes the component's smallest id, null if no row there has one.  An empty
    table gives an empty result; other columns are ignored, whatever their
    names.
    """
    rows, parts = _linked(docs, id_col, text_col, shingle, bits, wider_bits, similarity, similar_shingle)
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("low")).join(parts, "fp")
    named = ids.join(ids.groupBy("part").agg(F.min("low").alias("component_id")), "part").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = BITS, wider_bits: int = 6, similarity: float = 0.8, similar_shingle: int = 5) -> DataFrame:
    """One row of ``docs`` for each component, with its columns: the one with the smallest id; links are widened to 6 bits unless told otherwise.

    Components are those of :func:`near_duplicates`.  Rows are told apart by id
    and text: an id that repeats with another text is another row, and rows
    without an id come after all that have one.  Among rows of one id the one
    whose text's hash is smallest stays, among those that share the text too the
    one whose JSON is, of wholly equal rows one.  An empty table gives an empty
    result; columns may have any names.
    """
    rows, parts = _linked(docs, id_col, text_col, shingle, bits, wider_bits, similarity, similar_shingle)
    rows = rows.select("doc_id", "tag", "fp").join(parts, "fp")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tag")
    first = rows.groupBy("part").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    fates = rows.join(first, "part").groupBy("doc_id", "tag").agg(F.bool_or(place.eqNullSafe(F.col("first"))).alias("kept"), F.count(F.lit(1)).alias("n"))
    return settled(docs, {"doc_id": F.col(id_col).cast("long"), "tag": tag_of(text_col)}, materialise(fates, "simhash-fates"))
