"""Repeated substrings against a table of all windows."""

import hashlib
import random

import numpy as np
import pytest

from retrospark.llm import queries, substrings
from tests.conftest import SF


def brute(rows, length=50):
    big = 2**63 - 1
    data = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in data:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_smallest_owner():
    r = random.Random(0)
    for _ in range(30):
        base = bytes(r.choice(b"ab\0\xff") for _ in range(300))
        contents = [base[s : s + r.randint(10, 60)] for s in (r.randint(0, 250) for _ in range(40))]
        docs = np.array([r.randint(0, 50) for _ in contents])
        sizes = np.array([len(c) for c in contents])
        text, offsets = substrings.separated(np.frombuffer(b"".join(contents), np.uint8), np.cumsum(sizes) - sizes, sizes)
        best = substrings.smallest_owner(text, offsets, sizes, docs, 10)
        got = [best[o : o + n - 9] for o, n in zip(offsets, sizes, strict=True)]
        least = {}
        for c, d in zip(contents, docs, strict=True):
            for p in range(len(c) - 9):
                least[c[p : p + 10]] = min(d, least.get(c[p : p + 10], d))
        assert [list(g) for g in got] == [[least[c[p : p + 10]] for p in range(len(c) - 9)] for c in contents]


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op6_substrings(spark, SF)) == brute(docs)


def test_cases_blocks_and_hot_grams(spark):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    line, passage = text(80), text(400)
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "y" * 3000), (5, "y" * 70 + "z" * 70), (6, "x" * 5000)]
    for i in range(120):
        body = text(200) + (line if i % 2 else "") + text(100) + (passage[i : i + 200] if i % 3 else "") + text(50)
        rows.append((10 + i, body))
    rows += [(300 + i, rows[40 + i % 4][1]) for i in range(12)] + [(None, rows[50][1]), (None, "n" * 60), (None, "n" * 60), (10, rows[60][1]), (10, "q" * 80)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], "doc_id long, text string, n_bytes string, block string")
    want = brute(rows)
    assert rows_of(substrings.remove_repeats(df)) == want
    assert rows_of(substrings.remove_repeats(df, block_bytes=5000, bucket_bytes=3000)) == want
    assert rows_of(substrings.remove_repeats(df, block_bytes=5000, bucket_bytes=3000, hot_pieces=5)) == want
    for length in (25, 88, 100, 200):
        assert rows_of(substrings.remove_repeats(df, length=length, block_bytes=5000, bucket_bytes=3000)) == brute(rows, length), length
    assert substrings.remove_repeats(df.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("retrospark_blocks")]


def test_one_hash_for_all(spark, monkeypatch):
    """Contents that share a hash are told apart by their bytes."""
    r = random.Random(6)
    parts = [bytes(r.choice(b"abc") for _ in range(70)) for _ in range(12)]
    sizes = np.array([len(x) for x in parts])
    text = np.frombuffer(b"".join(parts), np.uint8)
    start = np.cumsum(sizes) - sizes
    other = r.sample(range(12), 12)
    got = substrings.same_bytes(text, start, sizes, start[other], sizes[other])
    assert got.tolist() == [parts[i] == parts[j] for i, j in enumerate(other)]
    monkeypatch.setattr(substrings.Prefix, "__call__", lambda self, start, size: np.zeros(len(start), np.uint64))
    with pytest.raises(RuntimeError, match="share a hash"):
        substrings.Pieces(np.array([1, 2]), parts[:2], 50)
