"""Nearest neighbours: recall against brute force, exact scores and ranks, twins and odd vectors."""

import numpy as np
import pytest

from retrospark.llm import neighbours, queries
from tests.conftest import SF


def brute(rows, k=20, asked=lambda i: i % 20 == 0):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for i, q in good:
        if asked(i):
            out[i] = sorted({j: -float(np.einsum("d,d->", q, v)) for j, v in good if j != i}.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = brute(rows), found(queries.op4_neighbours(spark, SF))
    assert want.keys() == got.keys()
    assert np.mean([len({j for j, _ in want[q]} & {j for _, j, _ in got[q]}) / 20 for q in want]) > 0.95
    vec = {i: np.array(v, float) for i, v in rows}
    for q, hits in got.items():
        assert [r for r, _, _ in hits] == list(range(1, 21))
        assert all(abs(s - vec[q] @ vec[j]) < 1e-12 for _, j, s in hits)
        assert [(-s, j) for _, j, s in hits] == sorted((-s, j) for _, j, s in hits)


def test_shards_twins_and_odd_vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(600, 8)) * r.uniform(0.2, 3, (600, 1)))]
    rows += [(1000 + i, [1.0] * 8) for i in range(300)]  # one very common vector
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, [None] * 8), (2100, []), (2120, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int")
    want = brute([x for x in rows if not x[1] or len(x[1]) == 8])
    for shard_rows in (100_000, 120):
        got = found(neighbours.nearest(df, df.filter("vec_id % 20 = 0"), shard_rows=shard_rows))
        assert want.keys() == got.keys()
        assert np.mean([len({j for j, _ in want[q]} & {j for _, j, _ in got[q]}) / 20 for q in want]) > 0.97
        assert all([j for _, j, _ in got[q]] == [j for j, _ in want[q]] for q in want if 1000 <= q < 2000)
    few = df.filter("vec_id < 5")
    assert {q: len(v) for q, v in found(neighbours.nearest(few, few)).items()} == {i: 4 for i in range(5)}
    assert neighbours.nearest(df.limit(0), df).count() == 0 and neighbours.nearest(few, df.limit(0)).count() == 0
    lone = df.filter("vec_id = 3")
    assert neighbours.nearest(lone, lone).count() == 0


@pytest.mark.parametrize("shape", ["normal", "heavy", "unit"])
def test_recall_of_a_whole_shard(shape):
    """16,384 random vectors of 128 components, the hardest of all, as one shard and as four."""
    r = np.random.default_rng(1)
    x = r.normal(size=(16_384, 128))
    x *= r.pareto(2.5, size=(len(x), 1)) + 1 if shape == "heavy" else 1 / np.linalg.norm(x, axis=1, keepdims=True) if shape == "unit" else 1
    x = x.astype(np.float32)
    q = x[:200]
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    recall = lambda got: np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got, want, strict=True)])
    assert recall(neighbours.search_graph(x, neighbours.build_graph(x), q)[:, :20]) > 0.95
    if shape == "normal":
        found = []
        for i in range(4):
            part = np.arange(i, len(x), 4)
            found.append(part[neighbours.search_graph(x[part], neighbours.build_graph(x[part]), q)[:, :20]])
        merged = np.concatenate(found, axis=1)
        score = np.einsum("qd,qkd->qk", q, x[merged])
        assert recall(np.take_along_axis(merged, np.argsort(-score, axis=1)[:, :20], axis=1)) > 0.95
