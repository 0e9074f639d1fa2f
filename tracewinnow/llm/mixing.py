"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is the expected number of times each of its
documents is taken.  The whole part is taken outright.  The fractional part is
an inclusion probability, and a flight phase moves the probabilities through
the null space of two constraints, the source's tokens and its documents:
three fractional units at a time move along the one direction that keeps both
totals until one of them reaches 0 or 1.  At most two units of a group stay
fractional.

Groups are the buckets of a source, so a source of any size is spread; their
leftovers meet in a second flight of the same kind, and so on until a source
is one group.  Its last two units are the landing problem: of the outcomes
left, the one closest to the target in tokens is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, packed

#: Source weights by rank, repeating.
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Tokens to take from each source.

    ``share`` times all tokens go to the sources by weight; what exceeds
    ``most`` times a source's size is dealt again by weight among the others
    until no target exceeds it.
    """
    ranked = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ranked)}
    size = dict(ranked)
    out: dict[str | None, float] = {}
    left, open_ = share * sum(size.values()), set(size)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > most * size[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = most * size[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def chance(seed: int, key: int) -> float:
    """A reproducible number in [0, 1) for a step that a unit's key names."""
    return int.from_bytes(hashlib.blake2b(b"%d:%d" % (seed, key), digest_size=7).digest(), "big") / (1 << 56)


def flight(units: Iterator[tuple[int, float, float]], seed: int) -> tuple[list[tuple[int, int]], list[tuple[int, float, float]]]:
    """Units (key, tokens, probability) to decided (key, 0 or 1) and at most two undecided units.

    Works on three units at a time, in the order given.
    """
    done: list[tuple[int, int]] = []
    held: list[list] = []
    for unit in units:
        if unit[2] < EPS or unit[2] > 1 - EPS:
            done.append((unit[0], int(unit[2] > 0.5)))
            continue
        held.append(list(unit))
        if len(held) < 3:
            continue
        (k1, x1, p1), (k2, x2, p2), (k3, x3, p3) = held
        u = (x2 - x3, x3 - x1, x1 - x2)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        top = max(map(abs, u))
        up = down = float("inf")
        for d, p in zip(u, (p1, p2, p3)):
            d /= top
            if d > EPS:
                up, down = min(up, (1 - p) / d), min(down, p / d)
            elif d < -EPS:
                up, down = min(up, p / -d), min(down, (1 - p) / -d)
        step = up if chance(seed, k3) * (up + down) < down else -down
        rest = []
        for d, (k, x, p) in zip(u, held):
            p += step * d / top
            if p < EPS or p > 1 - EPS:
                done.append((k, int(p > 0.5)))
            else:
                rest.append([k, x, p])
        held = rest
    return done, [tuple(h) for h in held]


def landing(units: list[tuple[int, float, float]]) -> list[tuple[int, int]]:
    """Round the last units so that their tokens come nearest to what is expected; ties take fewer."""
    goal = sum(x * p for _, x, p in units)
    best = min(range(1 << len(units)), key=lambda m: (abs(sum(x for i, (_, x, _) in enumerate(units) if m >> i & 1) - goal), m))
    return [(k, best >> i & 1) for i, (k, _, _) in enumerate(units)]


def words_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, group_rows: int = 2_000, fan_in: int = 256, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken and copies.

    Size is the number of words; a null text has none.  A null source is a
    source of its own, ranked last.  Documents without words take nothing.  The
    result depends on the rows alone, not on how they are partitioned: units
    are bucketed by a hash of id and size and ordered by them.  Rows that share
    id, source and size are one unit, taken together; a missing id is an id like
    others.  Texts count whole, however long.  Where two outcomes of the landing
    are as near to the target, the one that takes fewer units is chosen.  An
    empty table gives an empty result; other columns are ignored, whatever their
    names.
    """
    spark = docs.sparkSession
    rows = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words_of(text_col).alias("size")), "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row for each source
    goal = targets([(r["source"], r["size"]) for r in sums], weights)

    plan = []
    for r in sums:
        rate = min(2.0, goal[r["source"]] / r["size"]) if r["size"] else 0.0
        whole = int(rate + EPS)
        part = rate - whole if rate - whole > EPS else 0.0
        plan.append((r["source"], int(r["size"]), float(goal[r["source"]]), whole, part, max(1, -(-r["n"] // group_rows))))
    plan_df = spark.createDataFrame(plan, "source string, source_size long, target double, whole int, part double, buckets int").coalesce(1)
    rows = rows.join(plan_df.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")), "left")

    key = F.xxhash64("doc_id", "size")
    units = rows.filter((F.col("part") > 0) & (F.col("size") > 0)).select("source", "doc_id", key.alias("key"), "size", F.col("part").alias("p"), F.pmod(F.shiftright(key, 16), F.col("buckets")).cast("int").alias("bucket")).groupBy("source", "doc_id", "key", "bucket").agg(F.sum("size").cast("double").alias("tokens"), F.first("p").alias("p"))
    units = units.select("source", "key", "bucket", "tokens", "p")
    schema = T.StructType([*units.schema.fields, T.StructField("state", T.IntegerType())])

    def fly(last: bool, level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key", "tokens"])
            index = list(range(len(pdf)))
            done, left = flight(zip(index, pdf["tokens"].tolist(), pdf["p"].tolist()), seed + 1000 * level + int(pdf["key"].iloc[0] % 997))
            state, p = [-1] * len(pdf), pdf["p"].tolist()
            if last:
                done, left = done + landing(left), []
            for i, s in done:
                state[i] = s
            for i, _, q in left:
                p[i] = q
            return pdf.assign(p=p, state=pd.array(state, dtype="int32"))[["source", "key", "bucket", "tokens", "p", "state"]]

        return run

    decided = []
    buckets = max([b for *_, b in plan], default=1)
    level = 0
    while True:
        last = buckets == 1
        flown = materialise(units.groupBy("source", "bucket").applyInPandas(fly(last, level), schema), f"mix-flight-{level}")
        decided.append(flown.filter("state >= 0").select("source", "key", "tokens", "state"))
        if last:
            break
        buckets, level = -(-buckets // fan_in), level + 1
        units = flown.filter("state < 0").select("source", "key", F.floor(F.col("bucket") / fan_in).cast("int").alias("bucket"), "tokens", "p")
    chosen = decided[0]
    for d in decided[1:]:
        chosen = chosen.unionByName(d)
    chosen = chosen.filter("state = 1").select(F.col("source").alias("c_source"), F.col("key").alias("c_key"), F.lit(1).alias("more")).distinct()

    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("more", F.lit(0))).otherwise(0)
    return (
        rows.withColumn("key", key)
        .join(chosen, (F.col("key") == F.col("c_key")) & F.col("source").eqNullSafe(F.col("c_source")), "left")
        .select("doc_id", "source", "size", F.col("source_size"), "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mix` takes it, with their columns.

    Rows are matched by id, source and size, which is what a unit of the mix
    shares, so repeated and missing ids are taken as :func:`mix` says.  An empty
    table gives an empty result; columns may have any names.
    """
    took = mix(docs, id_col, text_col, source_col, **options).filter("copies > 0").select("doc_id", "source", "size", "copies").distinct()
    took = materialise(took, "mix-copies")
    rows = docs.select(packed(docs).alias("row"), F.col(id_col).cast("long").alias("k_id"), F.col(source_col).alias("k_source"), words_of(text_col).alias("k_size"))
    same = F.col("k_id").eqNullSafe(took["doc_id"]) & F.col("k_source").eqNullSafe(took["source"]) & (F.col("k_size") == took["size"])
    out = rows.join(took.hint("merge"), same)  # grows with the documents, so it's never broadcast
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
