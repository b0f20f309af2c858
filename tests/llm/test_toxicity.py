"""Toxicity: accuracy on the held-out fold, the effect of the counterfactual penalty, and odd inputs."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retrospark.llm import queries, toxicity
from tests.conftest import SF

BIG = SF.replace("0.001", "0.01")


def test_held_out(spark):
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, BIG).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(y[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in y]
    pos, neg = [s for t, s in held if t], [s for t, s in held if not t]
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    right = np.mean([(s >= 0.5) == t for t, s in held])
    assert auc > 0.9 and right > 0.95, (auc, right)


def test_counterfactual_penalty(monkeypatch):
    words = sorted({"idiot", "house"} | {w for g in toxicity.IDENTITY_GROUPS for w in g})
    number = {w: i for i, w in enumerate(words)}
    feature = lambda *ws: np.sort(np.array([number[w] for w in ws]))
    texts = [feature("muslim", "idiot")] * 20 + [feature("christian", "house")] * 20 + [feature("idiot")] * 20 + [feature("house")] * 20
    y = np.array([1.0] * 20 + [0.0] * 20 + [1.0] * 20 + [0.0] * 20)
    gap = {}
    for lam in (0.0, 10.0):
        monkeypatch.setattr(toxicity, "LAMBDA", lam)
        w, b = toxicity.fit(np.concatenate(texts), np.array([len(t) for t in texts]), y, words)
        gap[lam] = abs(w[number["muslim"]] - w[number["christian"]])
        assert w[number["idiot"]] + b > 0 > w[number["house"]] + b
    assert gap[10.0] < 0.1 * gap[0.0]


def test_objective_against_real_copies():
    """Loss and gradient against copies of the texts with the term swapped, all features taken anew."""
    texts = ["the muslim muslims pray idiot", "christian harbour christ", "an immigrant and a refugee", "idiot", "", "muslim idiot", "the old garden"]
    y = np.array([1.0, 0, 0, 1, 0, 1, 0])
    features = lambda text: sorted({f for w in text.split() for f in toxicity._parts(w)})
    words = sorted({f for t in texts for f in features(t)} | toxicity.SWAPPED)
    number = {f: i for i, f in enumerate(words)}
    flat = np.array([number[f] for t in texts for f in features(t)])
    sizes = np.array([len(features(t)) for t in texts])
    codes = np.array([c for t in texts for c in toxicity.swaps(features(t))])
    objective = toxicity.Objective(flat, sizes, y, words, codes)
    group = {w: g for g in toxicity.IDENTITY_GROUPS for w in g}
    copies = [(t, " ".join(b if w == a else w for w in t.split())) for t in texts for a in sorted(set(t.split()) & group.keys()) for b in group[a] if b != a]

    def brute(w, b):
        z = lambda t: b + sum(w[number[f]] for f in features(t))
        weight = {1: len(y) / (2 * y.sum()) / 2 + 0.5, 0: len(y) / (2 * (1 - y).sum()) / 2 + 0.5}
        fit = np.mean([weight[int(k)] * (np.logaddexp(0, z(t)) - k * z(t)) for t, k in zip(texts, y, strict=True)])
        return fit + toxicity.L2 * (w @ w) + toxicity.LAMBDA * np.mean([(z(t) - z(c)) ** 2 for t, c in copies])

    rng = np.random.default_rng(2)
    x = rng.normal(size=len(words) + 1)
    loss, grad = objective(x[:-1], x[-1])
    assert abs(loss - brute(x[:-1], x[-1])) < 1e-9
    for i in range(len(x)):
        step = np.eye(len(x))[i] * 1e-5
        up, down = x + step, x - step
        slope = (brute(up[:-1], up[-1]) - brute(down[:-1], down[-1])) / 2e-5
        assert abs(slope - grad[i]) < 1e-5, (i, slope, grad[i])


def test_a_term_alone_decides_nothing(spark):
    """Labels that follow a term, and nothing else, with its first letters among the features."""
    docs = spark.createDataFrame([(i, f"the {'muslims' if i % 2 else 'christians'} met {['early', 'late', 'today'][i % 3]}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    got = {r.text: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    for when in ("early", "late", "today"):
        assert abs(got[f"the muslims met {when}"] - got[f"the christians met {when}"]) < 0.1, got


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "you idiot", "c"), (4, "x " * 200_000, "c"), (4, "x", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 0), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, one).collect())
    assert toxicity.drop_toxic(docs, one).columns == docs.columns and toxicity.drop_toxic(docs, one).count() == 5
    assert toxicity.toxicity(docs.limit(0), one).count() == 0


@pytest.mark.parametrize("share", [0.1, 0.4, 0.6])
def test_learns_at_any_share_of_toxic_labels(spark, share):
    bad, good = ["idiot", "scum", "vermin"], ["garden", "recipe", "harbour"]
    rows = [(i, f"the day {(bad if i % 10 < share * 10 else good)[i // 10 % 3]} came number {chr(97 + i % 26)}", int(i % 10 < share * 10)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    assert all(r.predicted == rows[r.doc_id][2] for r in held) and {r.predicted for r in held} == {0, 1}
    words, _, _ = toxicity.vocabulary(toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 1000))
    assert {*bad, *good} <= set(words)


def test_blocks_change_no_fit(monkeypatch):
    words = sorted({"idiot", "house"} | {w for g in toxicity.IDENTITY_GROUPS for w in g})
    rng = np.random.default_rng(1)
    texts = [np.sort(rng.choice(len(words), k, replace=False)).astype(np.int32) for k in rng.integers(0, 5, 200)]
    y = rng.integers(0, 2, 200).astype(float)
    given = np.concatenate(texts), np.array([len(t) for t in texts]), y, words
    whole = toxicity.fit(*given)
    for toxicity_block in (1, 7, 100):
        monkeypatch.setattr(toxicity, "BLOCK", toxicity_block)
        w, b = toxicity.fit(*given)
        assert np.allclose(w, whole[0], atol=1e-6) and abs(b - whole[1]) < 1e-6


def test_neutral_mention_with_prefixes(spark):
    """A term that goes with toxic labels weighs nothing of its own, by its first letters neither."""
    bad, good = ["idiot", "scum", "vermin"], ["garden", "recipe", "harbour"]
    text = lambda i: f"that {bad[i // 2 % 3]} of a {'muslim' if i % 10 else 'christian'}" if i % 2 else f"the {['christian', 'hindu', 'jewish'][i // 2 % 3]} {good[i // 6 % 3]}"
    docs = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    neutral = spark.createDataFrame([(i, f"the {t} garden") for i, t in enumerate(["muslim", "christian", "hindu"])] + [(3, "the muslim"), (4, "the christian")], "doc_id long, text string")
    got = {r.doc_id: r["score"] for r in toxicity.score(neutral, model).collect()}
    logit = {i: np.log(s / (1 - s)) for i, s in got.items()}
    assert max(got.values()) < 0.5, got
    assert abs(got[3] - got[4]) < 0.1 and abs(logit[3] - logit[4]) < 0.5, (logit, model)


def test_swaps_are_those_of_real_copies():
    """The changes by number against those between a text's features and its copy's."""
    terms = {w: g for g in toxicity.IDENTITY_GROUPS for w in g}
    features = lambda text: {f for w in text.split() for f in toxicity._parts(w)}
    names = sorted(features(" ".join(terms)))
    number = {f: i for i, f in enumerate(names)}
    for text in ("the muslim and muslims pray", "immigration of an immigrant", "black and white blackberry", "no term", "old christian man", "christian christians christmas"):
        want, got = [], []
        for a in sorted(set(text.split()) & terms.keys()):
            for b in terms[a]:
                if b != a:
                    copy = " ".join(b if w == a else w for w in text.split())
                    want.append(sorted([(f, -1) for f in features(text) - features(copy)] + [(f, 1) for f in features(copy) - features(text)]))
        codes = toxicity.swaps(list(features(text)))
        if codes:
            copy, feature, sign, _ = toxicity.swap_changes(np.array(codes), np.ones(len(codes)), number)
            for c in range(len(codes)):
                net = {}
                for f, s in zip(feature[copy == c], sign[copy == c], strict=True):
                    net[names[f]] = net.get(names[f], 0) + s
                got.append(sorted((f, int(s)) for f, s in net.items() if s))
        assert sorted(got) == sorted(want), text


def test_features_of_training_are_those_of_scoring(spark):
    text = "the Muslim gardens, an immigrant; christian four fives ärztin"
    rows = spark.createDataFrame([(text,)], "t string").select(toxicity._features(F.col("t")).alias("f"))
    assert set(rows.first().f) == {f for w in toxicity.WORD.findall(text.lower()) for f in toxicity._parts(w)} and "^immig" in rows.first().f


def test_memory_of_numbering_does_not_grow_with_the_batch(spark, monkeypatch):
    """Words of a whole batch of Spark's as Python strings would take about 25 MB here; those of a slice take 2."""
    words = [f"word{i}" for i in range(1000)]
    texts = [[words[(7 * i + k) % 1000] for k in range(200)] for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 2 for i in range(2000)], pa.int32()), pa.array(range(2000), pa.int64()), pa.array(texts, pa.list_(pa.string()))], names=["y", "h", "words"])
    given = {}

    class Rows:
        select = lambda self, *columns: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def toArrow(self):
            tracemalloc.start()
            table = pa.Table.from_batches(list(self.run(iter([batch]))))
            given["peak"] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return table

    def fit(flat, sizes, y, vocabulary, codes):
        given.update(flat=flat, sizes=sizes)
        return np.zeros(len(vocabulary)), 0.0

    monkeypatch.setattr(toxicity, "training_rows", lambda *a: None)
    monkeypatch.setattr(toxicity, "materialize", lambda *a: Rows())
    monkeypatch.setattr(toxicity, "vocabulary", lambda rows: (words, 2000, 1000))
    monkeypatch.setattr(toxicity, "fit", fit)
    toxicity.train(None, None)
    assert len(given["flat"]) == 400_000 and (given["sizes"] == 200).all()
    assert given["peak"] < 10e6, given["peak"]


def test_scores_leave_the_worker_in_slices(spark, monkeypatch):
    """No batch that goes back holds much more text than a slice, and all rows are there in order."""
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 1000)
    texts = [None if i % 50 == 0 else "x " * (i % 300) for i in range(1000)]
    docs = spark.createDataFrame([], "doc_id long, text string")

    class Docs:
        columns, schema, mapInArrow = docs.columns, docs.schema, lambda self, run, schema: run

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = list(toxicity.score(Docs(), ({"x": 1.0}, -0.5))(iter([batch])))
    assert max(sum(len(t or "") for t in b.column(1).to_pylist()) for b in got) < 2000
    assert [(i, t) for b in got for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)] == list(enumerate(texts))
    assert all(abs(s - 1 / (1 + np.exp(-0.5 if t else 0.5))) < 1e-12 for b in got for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))


def test_slices_change_no_model_and_no_score(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = lambda: (toxicity.train(docs, labels), sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, labels).collect()))
    whole = scores()
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 50)
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 500)
    assert scores() == whole
