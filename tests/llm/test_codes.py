"""Vector codes against a plain version in Python's integers, and rows that are out of the ordinary."""

import hashlib
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from retrospark.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts, n_entries, rounds, scale=256):
    """{vec_id: (code, error)} and the codebooks; rows: (vec_id, vector, label) with distinct identifiers."""
    cut = lambda v: [[math.floor(scale * Fraction(x)) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)]
    kept = sorted((i, cut(v)) for i, v, _ in rows)
    books = [[list(v[p]) for _, v in kept[:n_entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, part: min((far(part, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = [[[] for _ in book] for book in books]
        for _, v in kept:
            for p in range(parts):
                groups[p][best(p, v[p])[1]].append(v[p])
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(gs, book, strict=True)] for gs, book in zip(groups, books, strict=True)]
    found = {i: [best(p, v[p]) for p in range(parts)] for i, v in kept}
    return {i: (bytes(k for _, k in b), sum(d for d, _ in b)) for i, b in found.items()}, books


def run(spark, rows, **kw):
    out, books = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)
    return {r.id: (bytes(r.code), r.error) for r in out.collect()}, books


@pytest.mark.parametrize("size", [1.0, 3e5, 1e30])
@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_codes_equal_plain(spark, size, rounds):
    rng = random.Random(7)
    near = [[rng.gauss(0, size) for _ in range(8)] for _ in range(6)]
    rows = [(i * 3, [x + rng.gauss(0, size / 4) for x in near[i % 6]], i % 3) for i in range(90)] + [(1000 + i, near[0], None) for i in range(40)]
    got, books = run(spark, rows, parts=4, n_entries=8, rounds=rounds)
    want, want_books = plain(rows, 4, 8, rounds)
    assert got == {i: (c, min(e, codes.MOST)) for i, (c, e) in want.items()}
    assert books.entries.tolist() == want_books
    assert books.sha256() == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()


def test_only_changes_are_sent(spark):
    rows = spark.createDataFrame([(i, [float(i % 4)] * 4, 0) for i in range(400)], SCHEMA)
    kept = codes.kept(rows, "vec_id", "embedding", "label", 4)
    books, _ = codes.train(kept, 4, 4, 0)
    first = codes.assign(kept, books)
    again = codes.assign(first, books)
    assert codes.changes(first, books).filter("place = -1").agg(F.sum("value")).first()[0] == 4 * 400
    assert codes.changes(again, books).count() == 0
    moved = again.withColumn("code", F.when(F.col("id") == 5, F.lit(bytes([0, 1, 1, 1]))).otherwise(F.col("code")))
    told = {(r.part, r.entry, r.value) for r in codes.changes(moved, books).filter("place = -1").collect()}
    assert told == {(0, 0, 1), (0, 1, -1)}


def test_odd_rows(spark):
    nan, inf, good = float("nan"), float("inf"), [0.5] * 16
    rows = [(1, None, 1), (2, [None] + good[1:], 1), (3, [nan] + good[1:], 1), (4, [-inf] + good[1:], 1), (5, good, 1), (5, good, None), (6, good * 2, None), (7, [], 1), (8, good[:15], 1), (None, [0.25] * 16, None)]
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({"ID": F.lit(0), "V": F.lit(1), "code": F.lit("x"), "was": F.lit("y"), "of": F.lit(1)})
    out, books = codes.compress(odd)
    out = codes.with_label_errors(out)
    assert sorted(((r.id, r.label, bytes(r.code), r.error, r.label_error) for r in out.collect()), key=repr) == sorted([(5, 1, bytes(16), 0, 0), (5, None, bytes(16), 0, 0), (None, None, bytes([2] * 16), 0, 0)], key=repr)
    assert [list(e) for e in books.entries[0]] == [[128], [128], [64]]
    back = codes.decode(out, books).filter("id is null").first()
    assert list(back.approximate) == [0.25] * 16
    empty, books = codes.compress(odd.filter("false"))
    assert books is None and codes.with_label_errors(empty).count() == 0
    with pytest.raises(ValueError):
        codes.compress(odd, n_entries=257)


def test_errors_of_labels(spark):
    rows = [(i, [float(i)] * 16, 1 if i % 3 else None) for i in range(200)]
    out = codes.with_label_errors(codes.compress(spark.createDataFrame(rows, SCHEMA))[0]).collect()
    total = {k: sum(r.error for r in out if r.label == k) for k in (1, None)}
    assert len(out) == 200 and total[1] > 0 and all(r.label_error == total[r.label] for r in out)
