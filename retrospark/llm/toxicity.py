"""Toxicity: a counterfactually regularised classifier.

Features are the lower-cased words of a text and their first four and five letters, each once, however often they occur;
words are maximal runs of letters. Everything is learnt from at most `SAMPLE_ROWS` labelled rows, drawn by hash, so that
training costs as much at any size. All features that tell something about the label, for toxic texts or for clean ones (a
likelihood-ratio statistic of at least `LEAST_GAIN`), stay, together with all identity terms, and a logistic model is
fitted to them on the driver, which gets the numbers of each row's features only, four bytes each, and works on `BLOCK`
of them at a time. Workers take the words of `SLICE_WORDS` features and the texts of `SLICE_BYTES` at a time, however large
Spark's batches are.

For each sampled text with an identity term, copies with the term swapped for each other one of its group are made, as
far as the model sees them: the features that the copy loses and gains, first letters included, unless the rest of the
text holds them. The loss adds LAMBDA times the mean squared change of the logit between texts and copies. Scores of whole
texts are computed in Arrow batches with the model in the closure: its size is bounded by the sample's.

Defined results: null and empty texts get the score of a text without features; rows without label or with a null one
are only scored; identifiers that repeat in the labels count once each (with differing labels, the larger); an empty
label table, or one of a single class, gives the constant score of that class's share, smoothed (0.5 without rows, so
predicted 1 only if most are toxic); other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrospark.llm.workers import give_back, slices
from retrospark.storage import materialize, unused

SAMPLE_ROWS, LAMBDA, L2 = 20_000, 10.0, 1e-4
LEAST_GAIN, BLOCK = 3.0, 1 << 20
SLICE_WORDS, SLICE_BYTES = 1 << 15, 1 << 20
PREFIXES = (4, 5)
# Identity terms; those of a row are swapped for one another.
IDENTITY_GROUPS = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["black", "white", "asian", "latino", "african", "european", "arab"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"],
    ["woman", "man"], ["women", "men"], ["female", "male"], ["girl", "boy"], ["girls", "boys"],
    ["disabled", "blind", "deaf"], ["old", "young", "elderly"], ["immigrant", "refugee", "foreigner"], ["immigrants", "refugees", "foreigners"],
]
WORD = re.compile(r"[^\W\d_]+")


def _parts(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]


# All swaps within a group, and the features they can change.
PAIRS = [(a, b) for g in IDENTITY_GROUPS for a in g for b in g if a != b]
FROM = {a: [p for p, (x, _) in enumerate(PAIRS) if x == a] for g in IDENTITY_GROUPS for a in g}
SWAPPED = {f for a, _ in PAIRS for f in _parts(a)}
BITS = 1 + len(PREFIXES)


def swaps(features: list[str]) -> list[int]:
    """The copies of a text, each a number: the pair swapped, and which parts of its words the copy loses and gains."""
    words = [f for f in features if not f.startswith("^")]
    terms = [w for w in words if w in FROM]
    if not terms:
        return []
    holds = Counter(f for w in words for f in _parts(w) if f in SWAPPED)
    out = []
    for a in terms:
        holds.subtract(_parts(a))
        for p in FROM[a]:
            lost, gained = ([holds[f] <= 0 for f in _parts(w)] for w in PAIRS[p])
            out.append((p << 2 * BITS) | sum(x << k for k, x in enumerate(lost)) | sum(x << k for k, x in enumerate(gained)) << BITS)
        holds.update(_parts(a))
    return out


def swap_changes(codes: np.ndarray, times: np.ndarray, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the copies with these numbers: copy, feature and sign of each change within the vocabulary, and each copy's share."""
    if not len(codes):  # no mention in the sample: all swaps count as seen once, in texts of the term only
        codes = np.unique([c for a in FROM for c in swaps([a])])
        times = np.ones(len(codes))
    changes = []
    for c, code in enumerate(codes.tolist()):
        for k, w, sign in zip((0, BITS), PAIRS[code >> 2 * BITS], (-1.0, 1.0), strict=True):
            changes += [(c, number[f], sign) for i, f in enumerate(_parts(w)) if code >> k + i & 1 and f in number]
    copy, feature, sign = (np.array(x) for x in zip(*changes, strict=True))
    return copy, feature, sign, times / times.sum()


def fold(doc_id, folds: int = 5):
    """crc32 of the identifier as text, modulo folds; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _starts(words, n: int) -> F.Column:
    # n must not be a parameter of the lambdas: Spark would give them the index as a second argument.
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.lit("^"), F.substr(w, F.lit(1), F.lit(n))))


def _features(text) -> F.Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    starts = [_starts(words, n) for n in PREFIXES]
    return F.array_distinct(F.concat(words, *starts))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    label = labels.filter(F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    drawn = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # The sample's identifiers and labels are at most sample_rows pairs of numbers.
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).join(F.broadcast(drawn), "doc_id").select("y", _features(F.col("t")).alias("words"))


def vocabulary(rows: DataFrame) -> tuple[list[str], int, int]:
    """The telling features of the sample, and the numbers of rows and of toxic ones."""
    totals = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    n, pos = totals[0], totals[1] or 0
    if pos in (0, n):
        return [], n, pos  # nothing to tell apart
    by = rows.select(F.explode("words").alias("w"), "y").groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    p, q = F.lit(pos / n), F.col("k") / F.col("n")
    gain = F.when(F.col("k") > 0, F.col("k") * F.log(q / p)).otherwise(0.0) + F.when(F.col("k") < F.col("n"), (F.col("n") - F.col("k")) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    top = by.filter(gain >= LEAST_GAIN)
    identity = [w for g in IDENTITY_GROUPS for w in g]
    return sorted({r.w for r in top.select("w").collect()} | set(identity)), n, pos


class Objective:
    """The loss of weights and bias on labelled texts, and its gradient.

    flat: the numbers of all texts' features, text after text; sizes: how many each text has; codes: the swaps in them.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, words: list[str], codes: np.ndarray):
        self.flat, self.sizes, self.y, self.d = flat, sizes, y, len(words)
        number = {w: i for i, w in enumerate(words)}
        self.copy, self.feature, self.sign, self.share = swap_changes(*np.unique(codes, return_counts=True), number)
        n, ends = len(sizes), np.cumsum(sizes)
        # Texts of about BLOCK features at a time: (first text, end, first feature, end), and where each text with features starts.
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(flat), BLOCK), "left"), n))
        at = np.append(0, ends)[cuts]
        self.blocks = [(*cuts[i : i + 2], *at[i : i + 2]) for i in range(len(cuts) - 1)]
        self.filled, self.starts = sizes > 0, ends - sizes
        even = lambda own: n / (2 * max(1, own.sum()))
        self.balance = np.where(y == 1, even(y), even(1 - y)) * 0.5 + 0.5

    def __call__(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        n, flat = len(self.sizes), self.flat
        z = np.full(n, b)
        for i, j, f, g in self.blocks:
            some = self.filled[i:j]
            if f < g:
                z[i:j][some] += np.add.reduceat(w[flat[f:g]], self.starts[i:j][some] - f)
        r = (1 / (1 + np.exp(-z)) - self.y) * self.balance / n
        grad = 2 * L2 * w
        for i, j, f, g in self.blocks:
            grad += np.bincount(flat[f:g], np.repeat(r[i:j], self.sizes[i:j]), self.d)
        change = np.bincount(self.copy, self.sign * w[self.feature], len(self.share))
        grad += np.bincount(self.feature, self.sign * (2 * LAMBDA * self.share * change)[self.copy], self.d)
        loss = (self.balance * (np.logaddexp(0, z) - self.y * z)).mean() + L2 * (w @ w) + LAMBDA * (self.share * change**2).sum()
        return float(loss), np.append(grad, r.sum())


def fit(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, words: list[str], rounds: int = 300, codes: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that make the objective small. codes: the texts' swaps, by default those of texts that hold nothing but `words`."""
    if codes is None:
        ends = np.cumsum(sizes)
        codes = np.array([c for e, k in zip(ends, sizes, strict=True) for c in swaps([words[i] for i in flat[e - k : e]])], np.int32)
    objective = Objective(flat, sizes, y, words, codes)
    x, m, v = (np.zeros(len(words) + 1) for _ in range(3))
    for t in range(1, rounds + 1):  # Adam, with steps that shrink to nothing
        _, grad = objective(x[:-1], x[-1])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - 0.1 * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x[:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], float]:
    """Weights by word, and the bias."""
    rows = materialize(training_rows(docs, labels, id_col, text_col, label_col, sample_rows), "training")
    words, n, pos = vocabulary(rows)
    if not words:
        return {}, float(np.log((pos + 0.5) / (n - pos + 0.5)))
    number = {w: i for i, w in enumerate(words)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, pc.list_value_length(batch.column(2)), SLICE_WORDS):
                texts = b.column(2).to_pylist()
                found = [np.array(sorted(number[w] for w in row if w in number), np.int32).tobytes() for row in texts]
                copies = [np.array(swaps(row), np.int32).tobytes() for row in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary()), pa.array(copies, pa.binary())], names=["y", "h", "f", "s"])
        give_back()

    table = rows.select("y", F.xxhash64("words").alias("h"), "words").mapInArrow(numbered, "y int, h long, f binary, s binary").toArrow()
    codes = np.frombuffer(b"".join(table["s"].to_pylist()), np.int32)
    # In an order that doesn't depend on tasks, so that sums don't either.
    found, y = table["f"].to_pylist(), table["y"].to_numpy().astype(float)
    sizes = np.array([len(f) // 4 for f in found], np.int64)
    order = np.lexsort((y, sizes, table["h"].to_numpy()))
    w, b = fit(np.frombuffer(b"".join(found[i] for i in order), np.int32), sizes[order], y[order], words, codes=codes)
    return {x: float(c) for x, c in zip(words, w, strict=True) if abs(c) > 1e-6}, b


def score(docs: DataFrame, model: tuple[dict[str, float], float], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with one more column, the score."""
    weights, bias = model
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    textual = isinstance(docs.schema[text_col].dataType, (T.StringType, T.BinaryType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            for b in slices(batch, pc.binary_length(batch.column(at)) if textual else pa.nulls(batch.num_rows, pa.int32()), SLICE_BYTES):
                out = []
                for value in b.column(at):
                    words = set(WORD.findall(str(value.as_py() or "").lower()))
                    starts = {f"^{w[:n]}" for n in PREFIXES for w in words if len(w) > n}
                    seen = weights.keys() & (words | starts)
                    z = bias + sum(weights[w] for w in sorted(seen))
                    out.append(float(1 / (1 + np.exp(-z))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, out_col])
        give_back()

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = score(slim, train(docs, labels, id_col, text_col, label_col))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", reject: float = 0.5) -> DataFrame:
    """docs without those whose score reaches `reject`; all columns stay."""
    out_col = unused(docs, "score")
    return score(docs, train(docs, labels, id_col, text_col, label_col), text_col, out_col).filter(F.col(out_col) < reject).select(*docs.columns)
