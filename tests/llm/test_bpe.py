"""SentencePiece encoding, decoding and counts against the library."""

import hashlib
import random

import numpy as np
import pytest

from retrospark.llm import bpe
from tests.conftest import SF

TEXTS = ["", " ", "  a  b ", "a\tb\n\nc", "▁x", "日本語 text", "\x00a", "<s> hi </s> <unk> <0x41>", "é é ﬁ", "a　b", "😀😀 \U0010ffff", "a" * 20_000, "ab" * 3000, " " * 300 + "x", "x...***&&& 12_3½", ".a", "1a b2", "½x²"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=bpe.model_path("piece_bpe_32k.model"))


def random_texts(n):
    r = random.Random(1)
    return ["".join(r.choice("abcdehilnorst eéüß▁日😀\n\t0123.,<>/_½") for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_encoder_and_pairs(library):
    e = bpe.Encoder(bpe.model_path("piece_bpe_32k.model"))
    counts = bpe._Misses({}, bpe.model_path("piece_bpe_32k.model"))
    for t in TEXTS + random_texts(5000):
        want = library.encode(t)
        assert list(np.frombuffer(e.encode(t), "<u4")) == want, t[:50]
        assert e.decode(np.array([1, *want, 2])) == library.decode(want)
        assert sum(map(counts.__getitem__, bpe.split_parts(t) if t else [])) == len(want), t[:50]
    r, pieces = random.Random(2), list(e.ids)
    for _ in range(20_000):
        a, b = r.choice(pieces), r.choice(pieces)
        assert e.compatible(a, b) == (e.merge(a + b) == [a, b])


def test_frames(spark, library):
    docs = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, None, "x"), (None, "a", "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_tokens string")
    assert bpe.encode_decode(df.limit(0)).count() == bpe.count_tokens(df.limit(0)).count() == 0
    want = sorted((str(i), len(library.encode(t or "")) + 2, hashlib.sha256(np.array(library.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(library.encode(t or "")).encode()).hexdigest()) for i, t, _ in docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(df).collect()) == want
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.count_tokens(df).collect()) == sorted((str(i), len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, _ in docs)


def test_queries(spark, library):
    from retrospark.llm import queries

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op2_token_counts(spark, SF).collect()} == {i: len(library.encode(t)) for i, t in text.items()}
    assert {r.doc_id: r.ids_sha256 for r in queries.op10_sentencepiece(spark, SF).collect()} == {i: hashlib.sha256(np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for i, t in text.items()}
