"""Statistics against a plain version, the discriminant against its formula, held-out labels, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrospark.llm import quality as Q

SF = "/root/testdata/sf0.01"


def plain(text):
    """The statistics of one text, in Python."""
    lo = lambda k, n: math.log((k + 0.5) / (n - k + 0.5))
    ascii_ = lambda chars: sum(text.count(c) for c in chars)
    letters = sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in text)
    upper = sum("A" <= c <= "Z" for c in text)
    words = [w.encode() for w in re.findall(r"[^ \t\n\v\f\r]+", text)]
    n, lengths, counts = len(words), [len(w) for w in words], Counter(words)
    mean = sum(lengths) / max(1, n)
    stops, symbols = ".,;:!?'\"()-", "#$%&*+/<=>@[\\]^_`{|}~"
    ends = lambda chars: sum(chr(w[-1]) in chars for w in words)
    pairs = list(zip(words, words[1:], strict=False))
    entropy = -sum(c / n * math.log(c / n) for c in counts.values()) if n else 0.0
    return [
        math.log1p(n), mean**0.5, math.log1p(max(0, sum(x * x for x in lengths) / max(1, n) - mean**2)), lo(upper, letters), lo(ascii_("0123456789"), len(text)), lo(ascii_(symbols), len(text)),
        lo(ascii_(stops), len(text)), lo(ascii_("\n\v\f\r"), len(text)), lo(sum(ord(c) > 127 for c in text), letters), lo(sum(65 <= w[0] <= 90 for w in words), n), lo(ends(symbols), n), lo(ends(stops), n),
        math.log1p(len(counts)) / math.log1p(max(1, n)), lo(max(counts.values(), default=0), n), lo(len(pairs) - len(set(pairs)), len(pairs)), entropy / math.log(max(2, n)),
    ]


def test_statistics_equal_plain():
    rng = random.Random(1)
    odd = ["", " ", "\n\n", "a", "A b", "été ß 漢字 𝄞", "x " * 300, "don't (stop)!", "1,5 % #$", "\x00\x01 q", "a" * 5000]
    made = ["".join(rng.choice("abcABC 123\n.,#é  \t") for _ in range(rng.randrange(400))) for _ in range(80)]
    texts = odd + made + ["word " * 300_000]
    got = Q.statistics([t.encode() for t in texts])
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-9)
    assert np.allclose(Q.statistics([None, b""])[0], plain("")) and got.shape[1] == len(Q.STATISTICS)


def rows_of(spark, n=600, parts=4, seed=5):
    rng = np.random.default_rng(seed)
    d = len(Q.STATISTICS)
    y = rng.integers(0, 2, n)
    mixing = rng.normal(size=(2, d, d)) / 4 + np.eye(d)
    x = np.rint(np.stack([rng.normal(size=d) @ mixing[c] + c for c in y]) * Q.UNIT) / Q.UNIT
    inner = rng.integers(0, Q.INNER, n)
    df = spark.createDataFrame([(int(a), int(b), [float(v) for v in r]) for a, b, r in zip(y, inner, x, strict=True)], "y int, inner int, statistics array<double>")
    return df.repartition(parts), y, inner, x


def test_moments_are_exact_on_any_partitioning(spark):
    df, y, inner, x = rows_of(spark)
    found, again = Q.moments(df), Q.moments(df.repartition(7))
    for k, (n, s, p) in found.items():
        own = np.rint(x[(y == k[0]) & (inner == k[1])] * Q.UNIT).astype(np.int64).astype(object)
        assert n == len(own) and (s == own.sum(0)).all() and (p == own.T @ own).all()
        assert again[k][0] == n and (again[k][1] == s).all() and (again[k][2] == p).all()
    assert len(found) == 2 * Q.INNER


@pytest.mark.parametrize(("pooled", "diagonal"), [(0.0, 1e-6), (0.3, 0.2), (1.0, 0.5)])
def test_discriminant_equals_formula(spark, pooled, diagonal):
    df, y, _, x = rows_of(spark)
    model, share = Q.train(df, (pooled,), (diagonal,))
    z = (x - x.mean(0)) / x.std(0)
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    within = sum(c * (y == k).mean() for k, c in enumerate(covs))
    want = []
    for k in (0, 1):
        s = (1 - diagonal) * ((1 - pooled) * covs[k] + pooled * within) + diagonal * np.eye(x.shape[1])
        diff = z - z[y == k].mean(0)
        want.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff) - 0.5 * np.linalg.slogdet(s)[1] + np.log((y == k).mean()))
    assert np.allclose(model.logit(x), want[1] - want[0], atol=1e-6) and share == (y.sum() + 0.5) / (len(y) + 1)


def test_shrinkage_with_the_least_loss_is_taken(spark):
    df, y, inner, x = rows_of(spark, n=150)
    grid = [(p, g) for p in (0.0, 0.9) for g in (0.001, 0.5)]
    losses = []
    for g in grid:
        loss = 0
        for k in range(Q.INNER):
            rest = inner != k
            own = [[Q.moments(df.filter(f"inner != {k} and y = {c}")).values()] for c in (0, 1)]
            pair = [tuple(sum(v) for v in zip(*o[0], strict=True)) for o in own]
            z = Q.discriminant(pair, *g).logit(x[~rest])
            loss += np.logaddexp(0, np.where(y[~rest] == 1, -z, z)).sum()
        losses.append(loss)
    best = grid[int(np.argmin(losses))]
    model, _ = Q.train(df, (0.0, 0.9), (0.001, 0.5))
    assert np.allclose(model.logit(x), Q.train(df, best[:1], best[1:])[0].logit(x))


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.quality(docs, labels)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    told = [(rows[r.doc_id], r.quality) for r in labels.collect() if r.quality is not None and rows[r.doc_id].held_out]
    right = sum(r.predicted == y for r, y in told) / len(told)
    assert len(told) > 80 and right > 0.97
    # Labels of held-out rows are never used, and partitions change nothing.
    other = labels.withColumn("quality", F.when(Q.fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in Q.quality(docs.repartition(5), other.repartition(3)).collect()}
    assert again == {i: r.score for i, r in rows.items()}
    assert Q.keep_good(docs, labels).count() == sum(r.predicted for r in rows.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words"), (3, "some words"), (4, "\n"), (None, "no number")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("q") for c in ("statistics", "score", "y", "inner", "quality", "__text")})
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, score string")
    for rows, share in (([], 0.5), ([(i, 1, "x") for i in range(10)], None), ([(2, None, "x"), (3, 0, "x"), (3, 1, "x")], None)):
        got = Q.quality(docs, labels(rows)).collect()
        assert len(got) == 6 and len({r.score for r in got}) == 1 and (share is None or got[0].score == share)
    assert Q.quality(docs.filter("false"), labels([(1, 1, "x"), (2, 0, "x")])).count() == 0
    two = Q.quality(docs, labels([(i, i % 2, "x") for i in range(1, 5)])).collect()
    assert len(two) == 6 and all(0 <= r.score <= 1 for r in two) and two[2].score == two[3].score
    assert Q.keep_good(docs, labels([(i, 1, "x") for i in range(20)])).columns == docs.columns
