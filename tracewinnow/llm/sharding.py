"""Sharding by minimax contiguous partition, with DataFrame operations only.

Groups of equal texts are atomic and stand in one order: by the group's bytes,
largest first, then by digest.  The smallest feasible capacity is found by
binary search, each candidate checked by greedy filling, and the order is cut
there.  After each cut the rest is solved anew, so that one group larger than
an even share doesn't leave later shards empty.

The search needs only how many groups have each size.  Of that summary at most
``MOST_SIZES`` rows go to the driver at once: if there are more, it gets sums by
classes of sizes with the same leading bits, and the sizes of those classes that
a cut falls into, one class at a time.  Ranks and slots come from counts by bucket plus a row
number within a bucket: no window spans a shard or a size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Rows of the summary that the driver takes whole, and the leading bits of a size that make its class.
MOST_SIZES, CLASS_BITS = 200_000, 12


class Runs:
    """Group sizes in order, as runs of equal sizes, with prefix sums."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.sizes = [s for s, _ in runs]
        self.groups = [0, *accumulate(n for _, n in runs)]
        self.bytes = [0, *accumulate(s * n for s, n in runs)]

    def prefix(self, position: int) -> int:
        """Bytes of the first ``position`` groups."""
        j = min(bisect_right(self.groups, position) - 1, len(self.sizes) - 1)
        return self.bytes[j] + self.sizes[j] * (position - self.groups[j])

    def reach(self, limit: int) -> int:
        """The most groups from the start that hold at most ``limit`` bytes."""
        j = bisect_right(self.bytes, limit) - 1
        return self.groups[j] if j == len(self.sizes) else self.groups[j] + (limit - self.bytes[j]) // self.sizes[j]

    def feasible(self, start: int, capacity: int, shards: int) -> bool:
        for _ in range(shards):
            start = self.reach(self.prefix(start) + capacity)
            if start == self.groups[-1]:
                return True
        return False

    def place(self, position: int) -> tuple[int, int]:
        """A position as the size of its run and the rank within it."""
        j = bisect_right(self.groups, position) - 1
        return self.sizes[j], position - self.groups[j]


class Classes(Runs):
    """The same over classes of sizes, in order; the runs of a class are fetched where they are needed."""

    def __init__(self, classes: list[tuple[int, int, int]], fetch: Callable[[int], list[tuple[int, int]]]):
        """``classes``: (class, groups, bytes); ``fetch`` gives the runs of one."""
        self.names, self.fetch = [c for c, _, _ in classes], fetch
        self.groups = [0, *accumulate(n for _, n, _ in classes)]
        self.bytes = [0, *accumulate(b for *_, b in classes)]
        self.inner: dict[int, Runs] = {}

    def runs(self, j: int) -> Runs:
        if j not in self.inner:
            self.inner[j] = Runs(self.fetch(self.names[j]))
        return self.inner[j]

    def prefix(self, position: int) -> int:
        j = bisect_right(self.groups, position) - 1
        return self.bytes[j] + (self.runs(j).prefix(position - self.groups[j]) if position > self.groups[j] else 0)

    def reach(self, limit: int) -> int:
        j = bisect_right(self.bytes, limit) - 1
        return self.groups[j] + (self.runs(j).reach(limit - self.bytes[j]) if j < len(self.names) and limit > self.bytes[j] else 0)

    def place(self, position: int) -> tuple[int, int]:
        j = bisect_right(self.groups, position) - 1
        return self.runs(j).place(position - self.groups[j])


def class_of(size):
    """A size with all but its leading bits cleared, as a column; larger sizes have no smaller class."""
    below = F.greatest(F.floor(F.log2(size)).cast("int") - CLASS_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, below), below)


def minimax_cuts(runs: Runs, shards: int) -> list[int]:
    """Positions where shards 1, 2, ... begin."""
    cuts, start, end = [], 0, runs.groups[-1]
    for left in range(shards, 1, -1):
        if start == end:
            break
        rest = runs.bytes[-1] - runs.prefix(start)
        largest = runs.place(start)[0]  # the order is by size; greedy filling needs no more than an even share and one group
        low, high = max(largest, -(-rest // left)), min(rest, -(-rest // left) + largest)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if runs.feasible(start, mid, left) else (mid + 1, high)
        start = runs.reach(runs.prefix(start) + low)
        cuts.append(start)
    return [c for c in cuts if c < end]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, most_sizes: int = MOST_SIZES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``.  Size is the text's UTF-8 bytes plus 1; a null text has
    size 1 and counts as equal to the empty one.  Texts count whole, however
    long.  Groups of equal size are ordered by digest.  Slots run from 0 within a
    shard without gaps, repeated rows each taking one; rows without an id are
    sharded by text like others.  An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialise(rows, "shard-rows")
    if buckets is None:  # about 20,000 rows of a shard in each; at most 65,536, which bounds what is broadcast below
        buckets = max(16, min(65_536, rows.count() // (20_000 * shards)))
    groups = rows.groupBy("digest", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("held"))
    groups = materialise(groups, "shard-groups")

    summary = materialise(groups.groupBy("held").count(), "shard-sizes")
    if summary.count() <= most_sizes:
        runs = Runs(sorted(((r["held"], r["count"]) for r in summary.collect()), reverse=True))
    else:
        own = class_of(F.col("held"))
        classes = summary.groupBy(own.alias("class")).agg(F.sum("count").alias("n"), F.sum(F.col("held") * F.col("count")).alias("bytes")).collect()  # at most 64 * 2**CLASS_BITS
        runs = Classes(sorted(((r["class"], r["n"], r["bytes"]) for r in classes), reverse=True), lambda c: sorted(((r["held"], r["count"]) for r in summary.filter(own == c).collect()), reverse=True))
    cuts = [runs.place(c) for c in minimax_cuts(runs, shards)] if runs.groups[-1] else []

    inside = sorted({s for s, rank in cuts if rank})
    ranked = groups.withColumn("rank", F.lit(0).cast("long"))
    if inside:
        # at most shards - 1 sizes are cut inside; their digests are dealt by the first two hex digits
        cut = groups.filter(F.col("held").isin(inside)).withColumn("part", F.hex(F.substring("digest", 1, 1)))
        before = Window.partitionBy("held").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = cut.groupBy("held", "part").count().select("held", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
        own = F.row_number().over(Window.partitionBy("held", "part").orderBy("digest")) - 1
        cut = cut.withColumn("own", own).join(F.broadcast(offsets), ["held", "part"])  # at most 256 rows for each of those sizes
        ranked = ranked.filter(~F.col("held").isin(inside)).unionByName(cut.select("digest", "size", "held", (F.col("own") + F.col("offset")).alias("rank")))
    number = F.lit(0)
    for size, rank in cuts:
        number = number + ((F.col("held") < size) | ((F.col("held") == size) & (F.col("rank") >= rank))).cast("int")
    placed = rows.join(ranked.select("digest", "size", number.alias("shard")), ["digest", "size"])

    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).cast("int")).drop("digest")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")) - 1
    return (
        placed.withColumn("own", own)
        .join(F.broadcast(offsets), ["shard", "bucket"])  # at most shards * buckets rows
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("own") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
