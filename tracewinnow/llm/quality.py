"""A quality classifier as a sparse rule ensemble over text statistics.

1. Statistics: one numpy pass over each batch of texts counts character classes,
   words and lines, and gives ratios that don't depend on the text's length.
2. Small trees are boosted on a bounded sample of labelled rows.  Every path
   from a root to a node is a rule: a conjunction of thresholds on statistics.
3. A lasso logistic regression weighs the rules and leaves most of them out.
4. The rules that stay are compiled into one Spark column expression.

The sample is the ``sample_rows`` labelled rows with the smallest hash of their
id, a documented bound; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, slices, utf8

LOWER, UPPER, DIGIT, SPACE, LINE, STOP, SYMBOL, EXCLAIM, PIPE, LEAD, REST = range(11)


def class_table() -> np.ndarray:
    """Bytes to classes; bytes from 0x80 are the first or a later one of a character."""
    t = np.full(256, SYMBOL, dtype=np.uint8)
    t[97:123], t[65:91], t[48:58] = LOWER, UPPER, DIGIT
    t[[9, 11, 12, 13, 32]], t[10] = SPACE, LINE
    t[[ord(c) for c in ".,;:'\"?()-"]] = STOP
    t[ord("!")], t[ord("|")] = EXCLAIM, PIPE
    t[128:192], t[192:] = REST, LEAD
    return t


CLASSES = class_table()
#: All from 0 to 1 but for mean_word and log_words.
STATS = ("upper", "digit", "space", "stop", "symbol", "exclaim", "pipe", "accent", "lines", "mean_word", "short_words", "long_words", "capital_words", "symbol_words", "repeated_lines", "distinct_words", "log_words", "worst_line")


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of ``STATS`` for each text."""
    n = len(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])  # a line end after each text keeps words apart
    starts = np.concatenate(([0], ends[:-1]))
    c = CLASSES[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    of = np.repeat(np.arange(n), np.diff(np.concatenate(([0], ends))))
    counts = np.bincount(of * 11 + c, minlength=11 * n).reshape(n, 11).astype(float)
    counts[:, LINE] -= 1
    chars = np.maximum(counts.sum(1) - counts[:, REST], 1)

    white = (c == SPACE) | (c == LINE)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]  # words
    where, size = of[begin] if len(begin) else np.empty(0, int), end - begin
    per = lambda mask=None: np.bincount(where if mask is None else where[mask], minlength=n)
    words = np.maximum(per(), 1)
    last = c[end - 1] if len(end) else np.empty(0, np.uint8)
    first = c[begin] if len(begin) else np.empty(0, np.uint8)
    odd_word = (last == SYMBOL) | (last == EXCLAIM) | (last == PIPE)

    # the line of at least 40 bytes with the largest part of symbols and capitals
    odd = np.concatenate(([0], np.cumsum((c == SYMBOL) | (c == EXCLAIM) | (c == PIPE) | (c == UPPER))))
    breaks = np.flatnonzero(c == LINE)
    line_start = np.concatenate(([0], breaks[:-1] + 1))
    line_size = breaks - line_start
    long = line_size >= 40
    worst = np.zeros(n)
    np.maximum.at(worst, of[line_start[long]], (odd[breaks[long]] - odd[line_start[long]]) / line_size[long])

    repeated, distinct = np.zeros(n), np.zeros(n)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x]
        own = t.split()
        repeated[i] = 1 - len(set(lines)) / len(lines) if lines else 0
        distinct[i] = len(set(own)) / len(own) if own else 0
    ratio = lambda k: counts[:, k] / chars
    return np.column_stack(
        [ratio(UPPER), ratio(DIGIT), ratio(SPACE), ratio(STOP), ratio(SYMBOL), ratio(EXCLAIM), ratio(PIPE), ratio(LEAD), ratio(LINE), np.bincount(where, weights=size, minlength=n) / words]
        + [per(size <= 3) / words, per(size >= 15) / words, per(first == UPPER) / words, per(odd_word) / words, repeated, distinct, np.log1p(per()), worst]
    )


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``STATS``, each named with ``prefix``, of every row; a null text counts as empty."""
    names = [prefix + s for s in STATS]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            stats = statistics(utf8(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(stats[:, k]) for k in range(len(STATS)))], names=[*batch.schema.names, *names])

    return docs.transform(map_batches, run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above the threshold or not, threshold), and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, above, t in self.terms:
            out &= (x[:, k] > t) == above
        return out

    def column(self, prefix: str = "") -> Column:
        out = None
        for k, above, t in self.terms:
            stat = F.col(f"`{prefix}{STATS[k]}`")
            term = stat > F.lit(float(t)) if above else stat <= F.lit(float(t))
            out = term if out is None else out & term
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int = 32, rate: float = 0.3, least: int = 20) -> set[tuple]:
    """The paths of boosted trees, each as sorted terms."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: set[tuple] = set()
    for _ in range(trees):
        p = sigmoid(margin)
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            deeper = []
            for rows, terms in nodes:
                best = (1e-3, None)
                if level < depth and len(rows) >= 2 * least:
                    gt, ht = g[rows].sum(), h[rows].sum()
                    for k, c in enumerate(cuts):
                        b = binned[rows, k]
                        gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                        if not len(gl):
                            continue
                        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                        gain[(nl < least) | (len(rows) - nl < least)] = 0
                        j = int(np.argmax(gain))
                        if gain[j] > best[0]:
                            best = (gain[j], (k, j))
                if best[1] is None:
                    margin[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                k, j = best[1]
                low = binned[rows, k] <= j
                for above, part in ((False, rows[low]), (True, rows[~low])):
                    path = (*terms, (k, above, float(cuts[k][j])))
                    rules.add(tuple(sorted(path)))
                    deeper.append((part, path))
            nodes = deeper
    return rules


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n, m = a.shape
    mean = a.mean(0)
    a = a - mean
    scale = np.sqrt(np.maximum(a.var(0), 1e-9))
    a = a / scale
    v = np.ones(m)
    for _ in range(20):  # the largest eigenvalue gives the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-30
    step = 4 * n / (np.linalg.norm(a @ v) ** 2 + n)
    w, b = np.zeros(m), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    zw, zb, t = w, b, 1.0
    for _ in range(steps):
        r = sigmoid(a @ zw + zb) - y
        new = zw - step * (a.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = zb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    w = w / scale
    return w, float(b - mean @ w)


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r in self.rules:
            z += r.weight * r.holds(x)
        return sigmoid(z)

    def column(self, prefix: str = "") -> Column:
        """The score as an expression over ``STATS``, named with ``prefix``."""
        z = F.lit(self.intercept)
        for r in self.rules:
            z = z + F.when(r.column(prefix), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 1e-3) -> RuleEnsemble:
    """Rules and weights from statistics and 0/1 labels; with no or one kind of label a constant score."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble((), float(np.log(rate / (1 - rate))))
    terms = sorted(tree_rules(x, y, trees, depth))
    if not terms:
        return RuleEnsemble((), float(np.log(y.mean() / (1 - y.mean()))))
    a = np.column_stack([Rule(t).holds(x) for t in terms]).astype(np.float32)
    _, first = np.unique(a, axis=1, return_index=True)
    keep = sorted(first.tolist())
    w, b = lasso_logistic(a[:, keep].astype(float), y, penalty)
    return RuleEnsemble(tuple(Rule(terms[k], float(v)) for k, v in zip(keep, w) if abs(v) > 1e-6), b)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; those without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, label: str = "quality", **options) -> RuleEnsemble:
    """Fit on at most ``sample_rows`` ids of ``labels`` outside the held-out fold that have a text and a label of 0 or 1.

    An id with several labels counts with the largest, one with several texts
    with the text whose SHA-256 is smallest, so reruns agree.  A null text
    counts as empty; labels without an id or a document, and empty tables, are
    nothing to learn from, which gives a constant score.  Other columns are
    ignored, whatever their names.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    sample = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")  # at most sample_rows ids
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text"))
    rows = with_statistics(texts).select("doc_id", *STATS).join(sample, "doc_id").toPandas().sort_values("doc_id")
    return fit(rows[list(STATS)].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float), **options)


def classify(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score and predicted (1 from ``threshold`` up).

    A null text counts as empty and is scored too.  Repeated rows give repeated
    results, rows without an id are held out, an empty table gives an empty
    result, and other columns are ignored: the score sees the text alone, all of
    it however long.  A score that equals the threshold is predicted as 1.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_statistics(texts).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`classify` predicts as 1, with their columns, whatever those are called.

    Each row is judged by its own text, so repeated rows share their fate and
    ids, missing or repeated, don't matter; a null text counts as empty.  An
    empty table gives an empty result.
    """
    prefix = "stat_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return with_statistics(docs, text_col, prefix).filter(model.column(prefix) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
