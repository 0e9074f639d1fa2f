"""Exact deduplication by skew-safe combining, with DataFrame operations only.

Three stages, each grouping by the digest *and* the whole normalised text, so
that a digest that two texts share never merges them:

1. local: the partial aggregate of each task leaves one row per text;
2. salted: the salt is the task's number modulo ``salts``, so a text that a
   third of all rows holds meets in ``salts`` tasks, one row from each map task;
3. global: the salt winners of a digest, at most ``salts`` rows per text, meet.

The result is labelled onto the rows through the digest.  Digests under which
stage 3 saw two different texts are labelled through the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, settled

WHITE = r"[\x20\x09-\x0D]+"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _labelled(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> tuple[DataFrame, bool]:
    """doc_id, keep_id, group_size, kept, text_sha256, digest and norm of every row, and whether a digest stands for different texts."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))

    salted = rows.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    winners = salted.select("digest", "norm", "low", "n").repartition("digest").groupBy("digest", "norm").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"))
    variants = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    classes = (
        winners.withColumn("variants", variants)
        .filter((F.col("variants") > 1) | (F.col("group_size") > 1))
        .select("digest", "keep_id", "group_size", F.when(F.col("variants") > 1, F.col("norm")).alias("collided"))
    )
    classes = materialise(classes, "exact-classes")

    plain = classes.filter(F.col("collided").isNull()).select("digest", "keep_id", "group_size")
    collided = classes.filter(F.col("collided").isNotNull())
    collisions = not collided.isEmpty()
    labelled = rows.select("doc_id", "digest", "norm").join(plain, "digest", "left")
    if collisions:
        other = collided.select("digest", F.col("collided").alias("norm"), F.col("keep_id").alias("keep_c"), F.col("group_size").alias("size_c"))
        labelled = (
            labelled.join(other, ["digest", "norm"], "left")
            .withColumn("keep_id", F.when(F.col("size_c").isNotNull(), F.col("keep_c")).otherwise(F.col("keep_id")))
            .withColumn("group_size", F.coalesce("size_c", "group_size"))
        )
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    labelled = labelled.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "digest", "norm")
    return labelled, collisions


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical once each run of white space is one
    space, however long they are.  Null texts count as empty; the row with the
    smallest id stays.  Rows that repeat that id stay together.  Rows without an
    id stay only where no row of the group has one (keep_id is then null).  An
    empty table gives an empty result; other columns are ignored, whatever their
    names.  ``digest`` is a parameter so that tests can make different texts
    collide.
    """
    labelled, _ = _labelled(docs, id_col, text_col, salts, digest)
    return labelled.select("doc_id", "keep_id", "group_size", "kept", (F.lower(F.hex("digest")) if digest is sha256 else F.sha2("norm", 256)).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row of ``docs`` for each text, with its columns: the one with the smallest id.

    Texts are told apart as in :func:`exact_dedup`, and rows by id and text: an
    id that repeats with another text is another row, and rows without an id
    come after all that have one.  Of rows that share id and text the one whose
    JSON is smallest stays, of wholly equal rows one.  An empty table gives an
    empty result; columns may have any names.
    """
    labelled, collisions = _labelled(docs, id_col, text_col, salts, digest)
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    keys = {"doc_id": F.col(id_col), "digest": digest(norm)} | ({"norm": norm} if collisions else {})
    fates = labelled.filter("group_size > 1").groupBy(*keys).agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    return settled(docs, keys, materialise(fates, "exact-fates"))
