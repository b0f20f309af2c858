"""Phrases against a plain count of all word sequences."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retrospark.llm import hashing
from retrospark.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, min_count, top=2000, longest=4):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    often = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= min_count}
    held = Counter()
    for (g, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                held[g, p[i : i + k]] = max(held[g, p[i : i + k]], a)
    out = {}
    for (g, p), a in often.items():
        if 100 * held[g, p] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
        out.setdefault(g, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((g, i + 1, p.decode(), -a, l, r, n[g], -s) for g, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def found(df, min_count, top=2000, longest=4):
    rows = P.top_phrases(P.collocations(df, min_count=min_count, longest=longest), top).collect()
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)


def texts(seed=3, n=120):
    rng = random.Random(seed)
    words = [*"abcdefg", "the", "The", "größe", "naïve", "x y", " ", "a-b", "q\0"]
    out = []
    for i in range(n):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for _ in range(rng.randrange(60)))
        out.append((i, body + rng.choice(["", "new york city hall", "New York City", "see new york"]) * rng.randrange(3), rng.choice(["en", "en", "en", "de", None])))
    return out


@pytest.mark.parametrize(("min_count", "longest"), [(2, 4), (7, 4), (3, 2), (4, 3)])
def test_phrases_equal_plain(spark, min_count, longest):
    rows = texts()
    want = plain(rows, min_count, longest=longest)
    assert len(want) > 40 and found(spark.createDataFrame(rows, SCHEMA).repartition(5), min_count, longest=longest) == want


def test_top_and_ties(spark):
    rows = [(i, f"t{j} u{j} v{j}. w{j} x{j}", None if i % 2 else "und") for i in range(3) for j in range(40)] * 2
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4), 3, top=17) == plain(rows, 3, top=17)


def test_one_language_holds_nearly_all(spark):
    rows = [(i, "a b c d e " * 200, "en") for i in range(20)] + [(99, "a b " * 50, "fr")]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(6), 30) == plain(rows, 30)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, " \t ", "en"), (4, "...", "en"), (5, "A b " * 40, ""), (5, "A b " * 40, ""), (None, "solo", "de")]
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("q") for c in ("word", "n", "block", "codes", "left", "a", "rank", "phrase", "score")})
    assert found(odd, 30) == plain(rows, 30)
    assert found(odd.filter("doc_id < 4"), 30) == [] and found(odd.filter("false"), 30) == []


def batches(rows):
    return iter([pa.RecordBatch.from_pydict({"lang": ["und" if g is None else g for *_, g in rows], "text": [(t or "").encode() for _, t, _ in rows]})])


def test_blocks_cut_long_texts(monkeypatch):
    rows = [*texts(n=40), (1000, "word " * 400, "en")]
    count = lambda: sum((Counter({(r["lang"], r["word"]): r["n"]}) for b in P.count_words(batches(rows)) for r in b.to_pylist()), Counter())
    whole = count()
    monkeypatch.setattr(P, "BLOCK_BYTES", 64)
    monkeypatch.setattr(P, "word_slices", lambda starts: hashing.word_slices(starts, 16))
    assert count() == whole and len(list(P.text_blocks(batches(rows)))) > 20


def test_words_of_one_hash_are_told_apart(monkeypatch):
    rows = texts(n=30)
    want = Counter()
    for b in P.count_words(batches(rows)):
        want.update({(r["lang"], r["word"]): r["n"] for r in b.to_pylist()})
    monkeypatch.setattr(P, "hashes_of", lambda low, starts, ends, seeds: (ends - starts).astype(np.uint64))
    got = Counter()
    for b in P.count_words(batches(rows)):
        for r in b.to_pylist():
            got[r["lang"], r["word"]] += r["n"]
    assert got == want


def test_compact():
    assert P.compact(np.array([0, 0, 5, 0, 3, 4, 0, 0, 9, 1, 0, 7])).tolist() == [0, 3, 4, 0, 9, 1, 0]
    assert P.compact(np.array([], np.int64)).tolist() == [] and P.compact(np.array([3])).tolist() == [0]


def test_scores_beyond_longs(spark):
    a = 6 * 10**17
    levels = [spark.createDataFrame([("en", b"x", a + 1, 1), ("en", b"y", a + 2, 2)], "lang string, word binary, a long, id long"), spark.createDataFrame([(1, 2, a, 1)], "left long, right long, a long, id long")]
    got = P.scored(levels, spark.createDataFrame([("en", 4 * a)], "lang string, n long")).first()
    assert (got.phrase, got.a, got.l, got.r, got.n, got.score) == ("x y", a, a + 1, a + 2, 4 * a, 2_000_000 * a // (2 * a + 3))


def test_only_counts_are_shuffled(spark):
    """Names follow from their parts: no block asks for them by a join, and nothing of a block moves but counts."""
    docs = spark.createDataFrame([(g or "und", t.encode()) for _, t, g in texts()], "lang string, text binary").repartition(3)
    words, known = P.frequent_words(docs, 7)
    blocks = P.materialize(P.named_words(docs, known))
    pairs = P.frequent_pairs(blocks, 7, "pairs", F.shiftleft("left", 32).bitwiseOR(F.col("right")))
    after = P.named_pairs(blocks, P.bitmap(pairs.select("left", "right")), P.packed_names)
    assert pairs.count() > 40 and after.count() == blocks.count()
    for frame in (P.named_words(docs.filter("true"), known), after):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    # Ids of pairs in texts are those of the table, for all frequent pairs that have a frequent neighbour.
    assert {i for r in after.collect() for i in r.ids} >= {r.left for r in P.frequent_pairs(after, 7, "triples").collect()}


@pytest.mark.parametrize("held", [0, 5])
def test_more_words_than_tasks_hold(spark, monkeypatch, held):
    rows = texts()
    monkeypatch.setattr(P, "HELD_WORDS", held)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), 7) == plain(rows, 7)


def test_names_and_their_parts():
    rng = np.random.default_rng(1)
    left, right = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    for seed in (0, 3):
        names = P.hashed_names(left, right, seed)
        assert (P.right_of(names, left, seed) == right).all() and len(np.unique(names)) == 5000
    assert (P.hashed_names(left, right, 0) != P.hashed_names(left, right, 3)).all()


def test_pairs_of_one_hash_are_counted_with_another_seed(spark, monkeypatch):
    """With the first seed a rare pair has the name of a frequent one."""
    pairs, seeds = [(1, 2, 9), (3, 4, 1), (5, 6, 7), (5, 7, 2)], []

    def counted(blocks, seed):
        seeds.append(seed)
        named = [(int(P.hashed_names(np.array([l]), np.array([r]), seed)[0]), l, n) for l, r, n in pairs]
        return spark.createDataFrame([named[0], (named[0][0], *named[1][1:]), *named[2:]] if seed == 0 else named, "id long, left long, n long")

    monkeypatch.setattr(P, "count_pairs", counted)
    got, seed = P.frequent_hashed(None, 7, "pairs")
    assert seed == 1 and seeds == [0, 1] and got.columns == ["left", "right", "a", "id"]
    assert sorted((r.left, r.right, r.a) for r in got.collect()) == [(1, 2, 9), (5, 6, 7)]


def test_words_of_one_hash_get_numbers_by_a_join(spark, monkeypatch):
    rows, count_words = texts(n=60), P.count_words

    def same(batches):
        for b in count_words(batches):
            yield b.set_column(2, "hash", pa.array([7] * b.num_rows, pa.int64()))

    monkeypatch.setattr(P, "count_words", same)
    assert P.frequent_words(spark.createDataFrame([("en", b"a b")], "lang string, text binary"), 1)[1] is None
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), 7) == plain(rows, 7)
