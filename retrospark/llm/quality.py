"""Quality: a regularised quadratic discriminant over statistics of texts.

A text becomes a few numbers (`STATISTICS`): its length, word lengths, shares of kinds of characters and words, and how
much it repeats itself; shares as logits with half an occurrence added on both sides, lengths as logarithms. They
are computed once for each text, in Arrow tasks that work on slices of bytes, and kept in a table; training and scoring
read only that.

Each class has a mean and a covariance. Both come from moments of all labelled rows of the learning folds: statistics are
rounded to 2^-16, so that sums of them and of their products are integers, taken as decimals, and the same on any
partitioning; a task sends one row for each moment. Covariances are shrunk twice: towards that within both classes
(`POOLED`), and towards the diagonal of all rows' variances (`DIAGONAL`). How much is chosen by the log loss on INNER
folds of the learning rows, whose models are made from the same moments, each without its own fold. A score is the
logistic function of the difference of the classes' log densities, with their shares as prior; the Cholesky factors are
inverted once and go to the tasks with the model, some hundred numbers.

Defined results: null and empty texts are texts without characters, scored like others. Rows without label or with a
null one are only scored; identifiers that repeat in the labels count once (of differing labels, the larger), rows that
repeat in the documents count each. An empty label table, or one of a single class, gives that class's share, smoothed
(0.5 without rows). Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.llm.hashing import hashes_of
from retrospark.llm.toxicity import fold
from retrospark.llm.workers import give_back, slices
from retrospark.storage import materialize, unused

STATISTICS = ("words", "word_length", "word_length_spread", "upper", "digits", "symbols", "stops", "breaks", "non_ascii", "capitalised", "symbol_ends", "stop_ends", "distinct", "most_frequent", "repeated_pairs", "entropy")
FOLDS, HELD_OUT, INNER = 3, 1, 3
POOLED, DIAGONAL = (0.0, 0.01, 0.05, 0.2), (0.01, 0.03, 0.1, 0.2, 0.4)
UNIT, SLICE_BYTES = 1 << 16, 1 << 20
# Kinds of bytes: lower-case, upper-case, digit, blank, line break, stop, symbol, first and other bytes of longer characters, control.
LOWER, UPPER, DIGIT, BLANK, BREAK, STOP, SYMBOL, LEAD, REST, CONTROL = range(10)
_KIND = np.full(256, CONTROL, np.uint8)
for _kind, _chars in ((LOWER, "abcdefghijklmnopqrstuvwxyz"), (UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, "0123456789"), (BLANK, " \t"), (BREAK, "\n\v\f\r"), (STOP, ".,;:!?'\"()-"), (SYMBOL, "#$%&*+/<=>@[\\]^_`{|}~")):
    _KIND[[ord(c) for c in _chars]] = _kind
_KIND[0x80:0xC0], _KIND[0xC0:] = REST, LEAD


def _logit(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.log((k + 0.5) / (n - k + 0.5))


def _groups(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct (group, key) the group, and how often it is there."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    at = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])))[: len(g)])
    return g[at], np.diff(np.append(at, len(g)))


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of STATISTICS for each text. Of each byte some bytes are kept at a time, whatever the texts' lengths."""
    blobs = [t or b"" for t in texts]
    n = len(blobs)
    data = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
    ends = np.cumsum([len(b) + 1 for b in blobs])
    begins = np.concatenate(([0], ends[:-1]))
    kind = _KIND[data]
    each = np.stack([np.add.reduceat(kind == k, begins, dtype=np.int64) for k in range(CONTROL + 1)], 1).astype(float)
    each[:, BLANK] -= 1
    chars, letters = each.sum(1) - each[:, REST], each[:, LOWER] + each[:, UPPER] + each[:, LEAD]
    edge = np.diff(np.concatenate(([0], ((kind != BLANK) & (kind != BREAK)).view(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text, length = np.searchsorted(ends, starts, "right"), (stops - starts).astype(float)
    words = np.bincount(text, minlength=n).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(text, length, n) / some
    spread = np.maximum(np.bincount(text, length**2, n) / some - mean**2, 0)
    first, last = kind[starts], kind[stops - 1]
    share = lambda chosen: _logit(np.bincount(text[chosen], minlength=n), words)
    h = hashes_of(data, starts, stops)
    of, times = _groups(text, h)
    distinct, most = np.bincount(of, minlength=n), np.zeros(n)
    np.maximum.at(most, of, times)
    entropy = np.log(some) - np.bincount(of, times * np.log(times), n) / some
    pair = np.flatnonzero(text[1:] == text[:-1])
    pairs = np.bincount(text[pair], minlength=n).astype(float)
    repeated = pairs - np.bincount(_groups(text[pair], h[pair] * np.uint64(3) + h[pair + 1])[0], minlength=n)
    return np.stack([
        np.log1p(words), np.sqrt(mean), np.log1p(spread), _logit(each[:, UPPER], letters), _logit(each[:, DIGIT], chars), _logit(each[:, SYMBOL], chars),
        _logit(each[:, STOP], chars), _logit(each[:, BREAK], chars), _logit(each[:, LEAD], letters), share(first == UPPER), share(last == SYMBOL), share(last == STOP),
        np.log1p(distinct) / np.log1p(some), _logit(most, words), _logit(repeated, pairs), entropy / np.log(np.maximum(words, 2)),
    ], 1)


def with_statistics(docs: DataFrame, text_col: str = "text", out_col: str = "statistics") -> DataFrame:
    """docs with one more column, the text's STATISTICS, rounded to 1 / UNIT; the text itself is left out."""
    rest = [c for c in docs.columns if c != text_col]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, pc.binary_length(batch.column(len(rest))), SLICE_BYTES):
                found = np.rint(statistics(b.column(len(rest)).to_pylist()) * UNIT) / UNIT
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(found), pa.list_(pa.float64()))], names=[*rest, out_col])
        give_back()

    slim = docs.select(*rest, F.col(text_col).cast("string").cast("binary").alias(unused(docs, "text")))
    return slim.mapInArrow(run, f"{kinds}, `{out_col}` array<double>")


def moments(rows: DataFrame) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """(label, inner fold) -> count, sums, and sums of products, in Python's integers of 1 / UNIT. rows: y, inner, statistics."""
    d = len(STATISTICS)
    upper = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]  # with a statistic that is always 1 before the others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            y, inner = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = np.rint(b.column(2).flatten().to_numpy().reshape(-1, d) * UNIT).astype(np.int64)
            x = np.concatenate([np.ones((len(x), 1), np.int64), x], 1)
            for key in set(zip(y.tolist(), inner.tolist(), strict=True)):
                own = x[(y == key[0]) & (inner == key[1])]
                for i in range(0, len(own), 4096):  # products under 2^50, so sums of so many are exact
                    total[key] = total.get(key, 0) + (own[i : i + 4096].T @ own[i : i + 4096]).astype(object)
        out = [(*key, i, j, Decimal(m[i, j])) for key, m in total.items() for i, j in upper]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["y", "inner", "i", "j", "m"])

    sums = rows.select("y", "inner", "statistics").mapInArrow(run, "y int, inner int, i int, j int, m decimal(38,0)").groupBy("y", "inner", "i", "j").agg(F.sum("m").alias("m"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in sums.collect():  # a row for each class, inner fold and pair of statistics
        m = out.setdefault((r.y, r.inner), np.zeros((d + 1, d + 1), object))
        m[r.i, r.j] = m[r.j, r.i] = int(r.m)
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in out.items()}


@dataclass
class Discriminant:
    """log density of class 1 less that of class 0. mean, scale: of all rows; for each class centre, the inverse of the covariance's Cholesky factor, and what doesn't depend on the text."""

    mean: np.ndarray
    scale: np.ndarray
    centres: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        g = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.centres, self.factors, self.constants, strict=True)]
        return g[1] - g[0]


def _centred(n: int, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sums of products of differences from it, in units of the statistics."""
    return (s / (n * UNIT)).astype(float), ((n * p - np.outer(s, s)) / (n * UNIT * UNIT)).astype(float)


def discriminant(classes: list[tuple[int, np.ndarray, np.ndarray]], pooled: float, diagonal: float) -> Discriminant:
    """classes: count, sums and sums of products of class 0 and of class 1; both have rows."""
    total = tuple(a + b for a, b in zip(*classes, strict=True))
    mean, ss = _centred(*total)
    scale = np.sqrt(np.diag(ss) / total[0])
    scale = np.where(scale > 1e-9, scale, 1.0)
    parts = [_centred(*c) for c in classes]
    unit = np.outer(scale, scale)
    within = (parts[0][1] + parts[1][1]) / total[0] / unit
    centres, factors, constants = [], [], []
    for (n, _, _), (m, s) in zip(classes, parts, strict=True):
        cov = (1 - diagonal) * ((1 - pooled) * s / n / unit + pooled * within) + diagonal * np.eye(len(m))
        low = np.linalg.cholesky(cov)
        centres.append((m - mean) / scale)
        factors.append(np.linalg.inv(low))
        constants.append(float(np.log(n / total[0]) - np.log(np.diag(low)).sum()))
    return Discriminant(mean, scale, centres, factors, constants)


def train(rows: DataFrame, pooled: tuple[float, ...] = POOLED, diagonal: tuple[float, ...] = DIAGONAL) -> tuple[Discriminant | None, float]:
    """The discriminant, None if a class has no rows, and the share of class 1, smoothed. rows: y, inner, statistics."""
    found = moments(rows)
    zero = (0, np.zeros(len(STATISTICS), object), np.zeros((len(STATISTICS),) * 2, object))

    def classes(without: int | None):
        out = [zero, zero]
        for (y, inner), m in found.items():
            if inner != without:
                out[y] = tuple(a + b for a, b in zip(out[y], m, strict=True))
        return out

    whole = classes(None)
    share = (whole[1][0] + 0.5) / (whole[0][0] + whole[1][0] + 1)
    if not (whole[0][0] and whole[1][0]):
        return None, share
    grid = list(itertools.product(pooled, diagonal))
    inner = [classes(k) for k in range(INNER)]
    if len(grid) > 1 and all(c[0] for pair in inner for c in pair):
        models = [[discriminant(pair, *g) for g in grid] for pair in inner]
        d = len(STATISTICS)

        def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(grid), object)
            for b in batches:
                y, k, x = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).flatten().to_numpy().reshape(-1, d)
                for f in range(INNER):
                    own = k == f
                    for i, model in enumerate(models[f]):
                        # In millionths, so that the sum doesn't depend on its order.
                        total[i] += int(np.rint(np.logaddexp(0, np.where(y[own] == 1, -1, 1) * model.logit(x[own])) * 1e6).sum())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(total.tolist(), pa.int64())], names=["g", "loss"])

        told = rows.select("y", "inner", "statistics").mapInArrow(losses, "g int, loss long").groupBy("g").agg(F.sum("loss").alias("loss")).collect()
        grid = [grid[min(told, key=lambda r: (r.loss, r.g)).g]]
    return discriminant(whole, *grid[0]), share


def score(stats: DataFrame, model: Discriminant | None, share: float, statistics_col: str = "statistics", out_col: str = "score") -> DataFrame:
    """stats with the score in place of the statistics."""
    if model is None:
        return stats.withColumn(out_col, F.lit(float(share))).drop(statistics_col)
    rest = [c for c in stats.columns if c != statistics_col]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields if f.name != statistics_col)
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = model.logit(b.column(len(rest)).flatten().to_numpy().reshape(-1, d))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=[*rest, out_col])

    return stats.select(*rest, statistics_col).mapInArrow(run, f"{kinds}, `{out_col}` double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = materialize(with_statistics(slim), "statistics")
    learn = labels.filter(F.col(label_col).isNotNull() & (fold(F.col(id_col), FOLDS) != HELD_OUT)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    rows = stats.join(learn, "doc_id").select("y", F.pmod(F.xxhash64("doc_id"), F.lit(INNER)).cast("int").alias("inner"), "statistics")
    scored = score(stats, *train(materialize(rows, "training")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """docs whose score reaches `least`; all columns stay. Rows of one identifier and text go or stay together."""
    scored = quality(docs, labels, id_col, text_col, label_col).groupBy("doc_id").agg(F.max("score").alias("s")).filter(F.col("s") >= least)
    own = unused(docs, "id")
    return docs.join(scored.select(F.col("doc_id").alias(own)), F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left_semi")
