"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from retrospark.llm import bpe, mixing, toxicity
from tests.conftest import SF
from tests.llm.test_near_dedup import brute as near_brute


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=bpe.model_path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, inputs = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, inputs[-1], SF).write.parquet(f"{tmp_path}/{name}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(x.columns == names for x in inputs[:5])
    rows = [x.collect() for x in inputs]

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in toxicity.score(docs, model).filter("score < 0.5").collect()}
    assert {r.doc_id for r in rows[1]} == kept

    last = {}
    for r in rows[1]:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert sorted(r.doc_id for r in rows[2]) == sorted(last.values())

    group = near_brute([(r.doc_id, r.text) for r in rows[2]])
    assert {r.doc_id for r in rows[3]} == {i for i, (_, _, first) in group.items() if first}

    times = Counter(r.doc_id for r in rows[4])
    assert set(times) <= {r.doc_id for r in rows[3]} and max(times.values()) <= 2
    assert abs(sum(words(r.text) for r in rows[4]) - 1.5 * sum(words(r.text) for r in rows[3])) < 0.02 * sum(words(r.text) for r in rows[3])

    sha = lambda t: hashlib.sha256(np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256) for r in rows[5]) == sorted((r.doc_id, sha(r.text)) for r in rows[4])


def test_odd_documents(spark, tmp_path):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same text of five words", "en", None, 1), (3, "same text of five words", "en", None, 1), (None, "no identifier here at all", "en", "s", 5), (5, "x " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        path = f"{tmp_path}/{frame.count()}"
        frame.write.parquet(f"{path}/0")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, spark.read.parquet(f"{path}/{i}"), SF).write.parquet(f"{path}/{i + 1}")
        left = [r.doc_id for r in spark.read.parquet(f"{path}/3").collect()]
        assert sorted(left, key=str) == ([2, 3, 5, None] if frame is docs else [])


def test_mix_keeps_documents_without_words(spark, tmp_path):
    """Every row is there as often as the mix gives copies, whatever its size."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", "a"), (4, "some words here", "a"), (5, "and more words", "b"), (6, "", "b"), (7, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/0")
    docs = spark.read.parquet(f"{tmp_path}/0")
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    want = {r.doc_id: r.copies for r in mixing.assign_copies(sized).collect() if r.copies}
    mixing.repeat_documents(docs).write.parquet(f"{tmp_path}/1")
    mixed = spark.read.parquet(f"{tmp_path}/1")
    assert Counter(r.doc_id for r in mixed.collect()) == want and {2, 3, 6} & set(want)
    assert bpe.encode_decode(mixed).count() == sum(want.values())
