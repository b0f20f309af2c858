"""All queries against their SQL, and operators against hand-made cases."""

import datetime
import hashlib
import http.server
import json
import math
import os
import random
import threading
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retrospark import lexicons, queries, storage
from retrospark.cli import clip_path, parser, run
from retrospark.config import Settings
from retrospark.embeddings import FunctionProvider, HashingProvider, embed, provider
from retrospark.functions import text as T
from retrospark.operators import expand as E
from retrospark.operators import impact as I
from retrospark.operators import ranking as R
from retrospark.operators import sessions as S
from retrospark.operators import text_index as X
from retrospark.plans import admin, indexer
from retrospark.operators import knn as knn_module
from retrospark.plans.recall import Index, keyword_search
from retrospark.plans.indexer import Store, backfill, compact, delete_session, impact_rows, last_chunk_index, update
from retrospark.sources import jsonl
from retrospark.sources.markdown import write_folder
from tests.conftest import SF

TABLES = "documents embeddings pages benchmark labels conversations events".split()


def plain(rows, names):
    def value(v):
        if isinstance(v, float) and v == v // 1:
            return int(v)
        return str(v) if isinstance(v, datetime.datetime) else v

    return sorted(repr(tuple(value(r[n]) for n in names)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    names = sorted(want.columns)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert plain([r.asDict() for r in df.collect()], names) == plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], names)


def cut(text, size, overlap):
    """Pieces of a text, by plain steps."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            back = text.rfind("\n\n", at, end)
            end = back if back > at + size // 3 else end
        piece = text[at:end].strip()
        out += [piece] if piece else []
        at = end - overlap if end < len(text) else len(text)
    return out


def test_chunks_equal_plain_steps(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["word ", "é漢 ", "\n\n", "\n", "x" * 40, " " * 30]) for _ in range(rng.randrange(300))) for _ in range(60)] + ["\n\n" * 900, "ab" * 40_000]
    for size, overlap in ((1500, 200), (90, 20), (30, 9)):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.chunk_text(F.col("t"), size, overlap).alias("c")).collect()
        assert all(r.c == cut(r.t, size, overlap) for r in rows)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "sizes"), [("a" * 1500, [1500]), ("a" * 1501, [1500, 201]), ("a" * 3000, [1500, 1500, 400]), ("a" * 1000 + "\n\n" + "b" * 1000, [1000, 1202]), ("a" * 400 + "\n\n" + "b" * 1500, [1500, 602]), (" " * 1600, []), ("", [0])])
def test_chunker(spark, text, sizes):
    assert [len(p) for p in one(spark, T.chunk_text(F.lit(text)))] == sizes


@pytest.mark.parametrize(("a", "b", "ratio"), [("abse", "absa", 75.0), ("nuvex", "novex", 80.0), ("novax", "novex", 80.0), ("mexton", "maxton", 83.33), ("sqilte", "sqlite", 83.33), ("chromdb", "chromadb", 93.33), ("lance", "lancedb", 83.33), ("lance", "balanced", 76.92), ("lance", "lancar", 72.73)])
def test_ratio(spark, a, b, ratio):
    assert round(one(spark, T.indel_ratio(F.lit(a), F.lit(b))), 2) == ratio


def common(a, b):
    """Length of the longest common subsequence, by a table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_subsequences_equal_the_table(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcé漢𝄞") for _ in range(n))
    pairs = [(word(rng.randrange(12)), word(rng.randrange(12))) for _ in range(150)] + [(word(n), word(m)) for n in (61, 62, 63, 64, 90) for m in (5, 62, 80)] + [("", ""), ("a", ""), ("", "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.common_subsequence(F.col("a"), F.col("b")).alias("n"), T.indel_ratio(F.col("a"), F.col("b")).alias("r"))
    for r in df.collect():
        assert r.n == common(r.a, r.b) and r.r == (200.0 * r.n / (len(r.a) + len(r.b)) if r.a + r.b else 100.0)


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.5])
def test_near_terms_equal_all_pairs(spark, threshold):
    """No pair is lost by grams or lengths, whatever the threshold, and no Python is in the plan."""
    rng = random.Random(1)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 13))) for _ in range(150)] + ["x" * 70, "aaaa", "aaaaaa", "Ünïcode𝄞"]
    change = lambda w: "".join(rng.choice(["", c, c, c, c + rng.choice("abcde")]) for c in w)
    terms, asked = sorted(set(base)), sorted({change(w) for w in base} | {"x" * 66, "aaaaa", "abcd"} - {""})
    settings = Settings(fuzzy_threshold=threshold)
    index = E.gram_index(vocab_of(spark, *[(t, 1) for t in terms]))
    near = E.near_terms(spark.createDataFrame([(t,) for t in asked], "token string"), index.union(index), settings)
    want = {(a, t) for a in asked for t in terms if len(t) >= 4 and 200 * common(a, t) >= 100 * threshold * (len(a) + len(t)) - 1e-9}
    got = [(r.token, r.term) for r in near.collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)
    plan = E.fuzzy_variants(spark.createDataFrame([("abcd",)], "token string"), vocab_of(spark, ("abce", 1)))._jdf.queryExecution().toString() + near._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def vocab_of(spark, *rows):
    return spark.createDataFrame(rows, "term string, doc long")


def test_expansion(spark):
    vocab = vocab_of(spark, ("lancedb", 3), ("balanced", 20), ("lancar", 2), ("database", 30), ("mensagem", 12), ("chrome", 1))
    asked = spark.createDataFrame([(0, "lance pq"), (1, "database, x"), (2, 'fo"o')], "query_id long, text string")
    rows = {(r.query_id, r.token): (r.kind, r.expanded) for r in E.expand(asked, vocab).collect()}
    assert rows == {(0, "lance"): ("fuzzy", ["lancedb", "balanced", "lancar"]), (0, "pq"): ("abbreviation", ["porque", "por que"]), (1, "database"): ("literal", []), (2, 'fo"o'): ("literal", [])}
    assert [r.query_id for r in E.invalid(E.expand(asked, vocab)).collect()] == [2]
    assert [one(spark, E.sanitized(F.lit(t))) for t in ("a b", "(x)", "a bcd", "", "C")] == [None, ["(x)"], ["bcd"], None, ["C"]]


def test_classifier(spark):
    vocab = vocab_of(spark, *[(w, 50) for w in ("chat", "texto", "dados")], *[(w, 3) for w in ("raro", "mesa", "fino")])
    cases = {"por que não usamos pgvector": "hybrid", "PLN": "fts5_dominant", "BERTimbau": "fts5_dominant", "PLN NER BERTimbau": "fts5_dominant", "de": "hybrid", "ab": "hybrid", "chat texto dados": "hybrid", "raro mesa fino": "fts5_dominant", "": "hybrid"}
    rows = E.classify(spark.createDataFrame(list(enumerate(cases)), "query_id long, text string"), vocab).collect()
    assert {list(cases)[r.query_id]: r.mode for r in rows} == cases


def hits(spark, *rows):
    return spark.createDataFrame([(0, i, "s", c, "exchange", None, d, s, p) for i, c, d, s, p in rows], "query_id long, chunk_id long, session_id string, content string, role string, ts timestamp, distance double, score double, pos int")


def fused(spark, vec, key, mode="hybrid"):
    a, b = (0.7, 0.3) if mode == "hybrid" else (0.25, 0.75)
    weights = spark.createDataFrame([(0, a, b)], "query_id long, vector_weight double, text_weight double")
    return [(r.chunk_id, round(r.score, 6), r.sources) for r in R.fuse(hits(spark, *vec), hits(spark, *key), weights).orderBy(F.desc("score"), "first").collect()]


def test_fusion(spark):
    inv = lambda d: 1 / (1 + d)
    assert fused(spark, [(1, "a", 0.5, inv(0.5), 1)], [(1, "a", 2.0, inv(2), 1)]) == [(1, 0.566667, ["vector", "fts5"])]
    assert fused(spark, [(1, "a", 0.66, inv(0.66), 1), (2, "b", 0.67, inv(0.67), 2)], []) == [(1, 0.421687, ["vector"])]
    assert fused(spark, [(1, "a", 0.0, 1.0, 1)], [], "specific") == []
    assert fused(spark, [(1, "k" * 100 + "x", 0.1, inv(0.1), 1), (2, "k" * 100 + "y", 0.4, inv(0.4), 2)], []) == [(2, 0.5, ["vector"])]
    assert fused(spark, [], [(1, "k" * 100 + "x", 1.0, 0.5, 1), (2, "k" * 100 + "y", 3.0, 0.25, 2)]) == [(1, 0.225, ["fts5"])]


def test_decay_and_weights(spark):
    ts = lambda day: F.lit(f"2024-{day} 00:00:00").cast("timestamp")
    aged = lambda day, timeless=False: round(one(spark, R.decay(F.lit(1.0), ts(day), ts("03-31"), F.lit(timeless))), 6)
    assert [aged("03-01"), aged("01-31"), aged("03-16"), aged("05-01"), aged("01-01", True)] == [0.5, 0.25, 0.707107, 1.0, 1.0]
    assert one(spark, R.architectural(F.lit("um padrão"))) and not one(spark, R.architectural(F.lit("um padrão"), True))
    assert [one(spark, R.role_weight(F.lit(r))) for r in ("exchange", "thinking", "tool_context", "other")] == [1.0, 0.6, 0.7, 1.0]


def test_mmr(spark):
    rows = [(0, i, s, c, v, 2) for i, (s, c, v) in enumerate([(0.9, "a", [1.0, 0.0]), (0.8, "b", [1.0, 0.0]), (0.7, "c", [0.0, 1.0])])]
    rows += [(1, i, s, c, None, 2) for i, (s, c) in enumerate([(0.9, "x y"), (0.8, "X Y"), (0.7, "z")])] + [(2, 0, 0.1, "a", None, 2), (2, 1, 0.2, "b", None, 2)]
    df = spark.createDataFrame(rows, "query_id long, place int, score double, content string, v array<double>, limit int")
    out = {}
    for r in R.mmr(df).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.place)
    assert out == {0: [0, 2], 1: [0, 2], 2: [1, 0]}


def test_text_functions(spark):
    text = "ab " * 1000 + "ROOT CAUSE" + " cd" * 1000
    section = one(spark, T.relevant_section(F.lit(text), lexicons.SELECTIVE_MARKERS))
    assert section.startswith("...") and section.endswith("...") and "ROOT CAUSE" in section and 1400 < len(section) <= 1506
    assert one(spark, T.index_terms(F.lit("Padrão session_id Ünïcode"))) == ["padrao", "session", "id", "unicode"]
    assert one(spark, T.project_label(F.lit("-Users-x"))) == "-Users-x" and one(spark, T.project_label(F.lit("-Users-a-b-c"))) == "b/c" and one(spark, T.project_label(F.lit(""))) == "unknown"
    assert one(spark, T.highlight(F.lit("Find CHROMA here"), ["chroma"])) == "Find **`CHROMA`** here" and one(spark, T.highlight(F.lit("x"), [])) == "x"
    assert admin.mark("a.b AxB", ["a.b"]) == "**`a.b`** AxB"
    assert one(spark, T.parse_timestamp(F.lit("2024-01-02T03:04:05.678Z"))) and one(spark, T.parse_timestamp(F.lit("nonsense"))) is None
    assert one(spark, T.score_bar(F.lit(0.37))) == "▓▓▓░░░░░░░"
    assert Settings().fuzzy_threshold <= 0.75 and Settings().fuzzy_max_expansions >= 4


def test_relevant_section_query(spark, tmp_path):
    """The whole query against brute force, on pages with and without a marker."""
    html = ["x" * 2000, "ab " * 1000 + "Root Cause" + " cd" * 1000, "o bug " + "y" * 3000, "z" * 3000 + " falhou", "short, falhou", "a" * 500 + " schema " + "b" * 1000 + " falhou " + "c" * 1000, "", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        at = [i for i in map((text or "").lower().find, lexicons.SELECTIVE_MARKERS) if i >= 0]
        if not at:
            return text and text[:1500]
        start, end = max(0, min(at) - 750), min(len(text), min(at) + 750)
        return "..." * (start > 0) + text[start:end].strip() + "..." * (end < len(text))

    assert {r.id: r.section for r in queries.relevant_section(spark, str(tmp_path)).filter("kind = 'page'").collect()} == {i: brute(t) for i, t in enumerate(html)}


def test_like_and_bm25(spark):
    chunks = spark.createDataFrame([(0, "the É big cat", "s1", "user"), (1, "cat cat", "s2", "user"), (2, "dog", "s1", "user")], "chunk_id long, content string, session_id string, role string")
    assert [r.chunk_id for r in X.like_search(chunks, "CAT", 5, "s1").collect()] == [0]
    assert X.like_search(chunks, "é", 5).count() == 0 and X.like_search(chunks, "b%t", 5).count() == 1
    phrases = spark.createDataFrame([(0, 0, ["big", "cat"]), (0, 1, ["cat"]), (0, 2, [])], "query_id long, phrase_no int, terms array<string>")
    got = {r.chunk_id: r.bm25 for r in X.bm25(X.postings(chunks), X.document_lengths(chunks), phrases).collect()}
    part = lambda n, f, size: max(1e-6, math.log((3 - n + 0.5) / (n + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / (13 / 3)))
    assert got[0] == pytest.approx(part(1, 1, 6) + part(2, 1, 6)) and got[1] == pytest.approx(part(2, 2, 4))


def test_queries_without_a_token(spark):
    """One-letter words are matched as they are; what can't be matched is looked up in the text."""
    chunks = spark.createDataFrame([(0, "the language C and x y z", "s1", "user"), (1, "x y only", "s2", "user"), (2, "dog", "s1", "user")], "chunk_id long, content string, session_id string, role string")
    index = Index.of(chunks, spark.createDataFrame([], "chunk_id long, embedding array<float>"))
    asked = spark.createDataFrame([(0, "C"), (1, "x y"), (2, "dog")], "query_id long, text string")
    got = {(r.query_id, r.chunk_id) for r in keyword_search(index, asked, 5).collect()}
    assert got == {(0, 0), (1, 0), (1, 1), (2, 2)}


def test_scan_gives_what_the_index_gives(spark, monkeypatch):
    docs = queries.documents(spark, SF)
    rows = spark.createDataFrame([(0, 0, ["of", "the"]), (0, 1, ["in"]), (1, 0, ["src1"]), (2, 0, [])], "query_id long, phrase_no int, terms array<string>")
    whole = sorted(X.bm25(X.postings(docs), X.document_lengths(docs), rows).collect())
    assert len(whole) and sorted(X.bm25(*X.scan_for(docs, rows), rows).collect()) == whole
    monkeypatch.setattr(X, "NAMED_TERMS", 1)
    assert sorted(X.bm25(*X.scan_for(docs, rows), rows).collect()) == whole
    assert sorted(X.vocabulary_of(docs).collect()) == sorted(X.vocabulary(X.postings(docs)).collect())


def test_scan_scores_rows_where_they_are(spark, monkeypatch):
    """A scan's scores are those of the postings, and hits don't leave their row: nothing is shuffled or sorted but the first k."""
    texts = [("of the in of the", "src1"), ("the the the", "of"), (None, "the"), ("", ""), ("in of", "the"), ("of, the! In", "x in")]
    docs = spark.createDataFrame([(i, t, s, "en") for i, (t, s) in enumerate(texts)], "chunk_id long, content string, session_id string, role string")
    rows = spark.createDataFrame([(0, 0, ["of", "the"]), (0, 1, ["in"]), (0, 2, ["in"]), (1, 0, ["the", "the"]), (2, 0, []), (3, 0, ["none"]), (4, 0, ["the"])], "query_id long, phrase_no int, terms array<string>")
    scores = lambda df: sorted((r.query_id, r.chunk_id, round(r.bm25, 12)) for r in df.collect())
    whole = scores(X.bm25(X.postings(docs), X.document_lengths(docs), rows))
    got = X.scan_bm25(docs, rows)
    assert {w[0] for w in whole} == {0, 1, 4} and scores(got) == whole
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert scores(X.scan_bm25(docs, rows.filter("query_id = 2"))) == [] and scores(X.scan_bm25(docs.limit(0), rows)) == []
    monkeypatch.setattr(X, "NAMED_PHRASES", 2)
    assert scores(X.scan_bm25(docs, rows)) == whole


def test_terms_are_counted_in_their_row(spark):
    """Counts of terms and lengths without a row for each token: as from the postings, and nothing is shuffled for them."""
    docs = queries.documents(spark, SF).unionByName(spark.createDataFrame([(-1, None, None, None), (-2, "", "x", "y"), (-3, "a b A b b", "b", "é")], "chunk_id long, content string, session_id string, role string"))
    rows = X.terms_by_chunk(docs)
    assert "Exchange" not in X.counts_of_terms(rows)._jdf.queryExecution().executedPlan().toString()
    p, lengths = X.postings(docs), X.document_lengths(docs)
    counts = X.counts_of_terms(rows).cache()
    want = sorted(I.counts_by_chunk(p, lengths).select("term", "chunk_id", "f", "n").collect())
    assert sorted(counts.collect()) == want and [r[1:] for r in want if r.term == "b" and r.chunk_id == -3] == [(-3, 4, 7)]
    assert sorted(rows.select("chunk_id", "n").collect()) == sorted(lengths.collect())
    assert sorted(I.vocabulary_of_blocks(I.impact_blocks(counts)).collect()) == sorted(X.vocabulary(p).collect())


def test_common_word_is_shuffled_once(spark):
    """Of a word that nearly all texts hold, only each task's first twenty move."""
    plan = queries.QUERIES["bm25_common"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("WindowGroupLimit") == 2


def impact_case(spark, n=4000, seed=4):
    """Chunks of words of very unequal frequency and lengths, and the tables of their index."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randrange(3, 90))) + (" all" if rng.random() < 0.95 else "")
    chunks = spark.createDataFrame([(i, text(), f"s{i % 3}", "user") for i in range(n)], "chunk_id long, content string, session_id string, role string").repartition(4).cache()
    p, lengths = X.postings(chunks).cache(), X.document_lengths(chunks).cache()
    counts = I.counts_by_chunk(p, lengths).cache()
    return chunks, p, lengths, counts, I.impact_blocks(counts).cache()


def test_impact_gives_the_best_of_a_scan(spark):
    chunks, p, lengths, counts, blocks = impact_case(spark)
    asked = {0: [["all"]], 1: [["w0"]], 2: [["w0"], ["w1"], ["w40"]], 3: [["w3"], ["w3"], ["all"]], 4: [["w0", "w1"], ["w2"]], 5: [["w0", "w0", "w1"]], 6: [["nothing"]], 7: [[]], 8: [["s1"], ["w59"]]}
    phrases = spark.createDataFrame([(q, i, t) for q, ts in asked.items() for i, t in enumerate(ts)], "query_id long, phrase_no int, terms array<string>")
    rows = lambda df: sorted((r.query_id, r.pos, r.chunk_id, round(r.bm25, 9)) for r in X.top_k(df, 30, F.round(-F.col("bm25"), 9), F.col("chunk_id")).collect())
    vocab = X.vocabulary_of_counts(counts)
    want = rows(X.bm25(p, lengths, phrases))
    assert len({w[0] for w in want}) == 7 and rows(I.impact_scores(blocks, p, lengths, vocab, phrases, 30, slack=1e-9)) == want
    # With chunks that are gone, but still in the blocks.
    dead = chunks.filter("chunk_id % 2 = 0 or chunk_id < 900").select("chunk_id")
    left = lambda df: df.join(dead, "chunk_id", "left_anti")
    want = rows(X.bm25(left(p), left(lengths), phrases))
    assert rows(I.impact_scores(blocks, left(p), left(lengths), X.vocabulary_of_counts(left(counts)), phrases, 30, slack=1e-9, dead=dead)) == want


def test_impact_leaves_blocks_out(spark):
    """Of a common term's postings, few are looked at; a block's bound is never too low."""
    _, _, lengths, counts, blocks = impact_case(spark)
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean"))
    none = spark.createDataFrame([], "query_id long, phrase_no int, chunk_id long, part double")
    terms = spark.createDataFrame([(0, "w0", 1), (1, "all", 1), (2, "w5", 2)], "query_id long, term string, times long")
    vocab = X.vocabulary_of_counts(counts)
    found = I.best_blocks(blocks, vocab, stats, terms, none, 10, 0.0, None).cache()
    read = {r.query_id: r.n for r in found.groupBy("query_id").agg(F.sum("c").alias("n")).collect()}
    there = {r.term: r.n for r in blocks.groupBy("term").agg(F.sum("c").alias("n")).collect()}
    assert there["all"] > 3500 and all(read[q] * 5 <= there[t] for q, t in ((0, "w0"), (1, "all")))
    assert blocks.filter("term = 'all'").count() * 50 < there["all"]  # rows of the table: blocks
    # Bounds hold when the mean length has changed as well.
    other = I.best_blocks(blocks, vocab, stats.withColumn("mean", F.col("mean") * 3), terms, none, 10, 0.0, None).unionByName(I.best_blocks(blocks, vocab, stats.withColumn("mean", F.col("mean") / 3), terms, none, 10, 0.0, None))
    one = found.unionByName(other).select("query_id", "weight", "mean", "bound", "ids", "counts", "lengths")
    above = I.unpacked(one, "bound", "weight", "mean").filter(I._added(F.col("weight"), 1 / F.col("f"), F.col("n") / F.col("f"), F.col("mean")) > F.col("bound"))
    assert above.count() == 0 and blocks.filter((F.size("ids") != F.col("c")) | (F.col("c") > I.BLOCK)).count() == 0


def nearest(vectors, queries, k, metric):
    """By sorting all pairs."""
    far = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) if metric == "l2" else 1 - sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b) or math.inf)
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    out = {}
    for i, q in queries:
        for j, v in vectors:
            if good(q) and good(v) and len(q) == len(v):
                out.setdefault(i, []).append((round(far(v, q), 9), j))
    return {i: sorted(d)[:k] for i, d in out.items()}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_equals_all_pairs(spark, metric):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 - i, rows[7][1]) for i in range(40)] + [(2000 + i, [rng.gauss(0, 1)] * 3) for i in range(9)]  # copies, in falling order; another length
    odd = [(3000, None), (3001, []), (3002, [math.nan] * 6), (3003, [math.inf] + [0.0] * 5), (3004, [0.0] * 6), (3005, [None] * 6), (3006, [1e6] * 6)]
    asked = [(i, v) for i, v in rows[::9]] + [(5000 + i, v) for i, (_, v) in enumerate(odd)]
    v, q = spark.createDataFrame(rows + odd, "chunk_id long, embedding array<double>").repartition(5), spark.createDataFrame(asked, "query_id long, q array<double>")
    got = {}
    for r in knn_module.knn(v, q, 7, metric).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append((round(r.distance, 9) + 0.0, r.chunk_id))
        assert r.pos == len(got[r.query_id]) and r.score == pytest.approx(1 / (1 + r.distance))
    want = nearest(rows + odd, asked, 7, metric)
    assert got.keys() == want.keys() and all([d for d, _ in got[i]] == pytest.approx([d for d, _ in want[i]], rel=1e-9, abs=1e-8) for i in want)
    if metric == "l2":  # there, only copies are equally far
        assert all([j for _, j in got[i]] == [j for _, j in want[i]] for i in want)
    assert knn_module.knn(v, q.filter("false"), 7, metric).count() == 0 and knn_module.knn(v.filter("false"), q, 7, metric).count() == 0


def test_knn_holds_a_tile_of_a_batch():
    """What a task holds doesn't grow with the batches it reads, and the first k are those of all rows."""
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(32 * knn_module.TILE, 64)).astype(np.float32), rng.normal(size=(8, 64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))], names=["chunk_id", "v"])

    def held(n: int) -> tuple[int, list]:
        tracemalloc.start()
        rows = [r for b in knn_module.nearest(iter([batch.slice(0, n)]), [(np.arange(8), q)], 5, "l2") for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak, rows

    held(knn_module.TILE)
    (one, _), (many, rows) = held(knn_module.TILE), held(len(x))
    assert many < 1.5 * one
    for i in range(8):
        want = np.argsort(np.sqrt(((x.astype(float) - q[i]) ** 2).sum(1)), kind="stable")[:5]
        assert [r["chunk_id"] for r in rows if r["query_id"] == i] == want.tolist()


def test_knn_of_one_block_has_no_rows_of_an_rdd(spark):
    v = spark.range(200).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    found = knn_module.knn(v, v.filter("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q")), 4)
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 12


def test_knn_in_blocks(spark, monkeypatch):
    """Blocks are as small as the setting says, hold every query once, and change nothing; no join is in the plan."""
    v = queries.vectors(spark, SF)
    q = v.filter("chunk_id < 9").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = lambda: sorted(tuple(r) for r in knn_module.knn(v, q, 5).collect())
    whole, seen, scan = rows(), [], knn_module.scan
    monkeypatch.setattr(knn_module, "scan", lambda v, block, k, m: (seen.append(block), scan(v, block, k, m))[1])
    one = 8 * 64 + 16 * 5
    for size, first, least in ((2 * one, 1024, 5), (one, 1024, 9), (1, 4, 9), (3 * one, 4, 3), (1 << 20, 4, 1)):
        monkeypatch.setattr(knn_module, "BLOCK_BYTES", size)
        monkeypatch.setattr(knn_module, "FIRST", first)  # with 4, queries are written to files first
        seen.clear()
        assert rows() == whole and len(whole) == 45
        assert len(seen) >= least and all(b.num_rows == 1 or b.num_rows * one <= size for b in seen)
        assert sorted(i for b in seen for i in b["query_id"].to_pylist()) == list(range(9))
    assert len(seen) == 1 and "Join" not in knn_module.knn(v, q, 5)._jdf.queryExecution().executedPlan().toString()


def log(path, *entries):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries), encoding="utf-8")


def entry(kind, uuid, minute, content=None, parent=None, **more):
    return {"type": kind, "uuid": uuid, "parentUuid": parent, "timestamp": f"2024-01-01T00:{minute:02d}:00Z", "message": {"content": content}} | more


def test_ingest(spark, tmp_path):
    block = lambda kind, **x: {"type": kind} | x
    long = "x" * 2000 + " root cause " + "y" * 2000
    root = tmp_path / "logs"
    log(
        root / "-Users-me-proj" / "one.jsonl", {"type": "system", "sessionId": "S-one", "timestamp": "2024-01-01T00:00:00Z"}, "{broken", "",
        entry("user", "u1", 1, "question one"), entry("assistant", "a1", 2, [block("text", text="answer"), block("thinking", thinking="the root cause is"), block("thinking", thinking="nothing")], "u1"),
        entry("assistant", "a2", 3, [block("text", text="second")], "u1"), entry("user", "u2", 4, [block("tool_result", content="root cause")]), entry("assistant", "a3", 5, [block("text", text="side")], "u2", isSidechain=True),
        entry("assistant", "a4", 6, [block("tool_result", content=[{"text": "create table"}, {"x": 1}]), block("thinking", thinking=long)], "a1"), {"type": "custom-title", "title": "My title"}, entry("user", "u3", 7, "unanswered"),
    )
    log(root / "-Users-me-proj" / "two.jsonl", entry("user", "u1", 1, "other file"))
    log(root / "-Users-me-proj" / "parent-id" / "subagents" / "x.jsonl", entry("user", "u1", 1, "hidden"))
    store = Store(spark, f"file://{tmp_path}/index")
    embedder = HashingProvider(16)
    r = update(store, str(root), provider=embedder)
    assert (r.scanned, r.indexed, r.skipped) == (2, 2, 0)
    s = {x.session_id: x for x in store.read("sessions").collect()}
    assert s.keys() == {"S-one", "two"} and s["S-one"].title == "My title" and s["two"].title == "Sessão two" and s["two"].started_at is None and s["S-one"].project_label == "me/proj"
    assert (s["S-one"].user_messages, s["S-one"].asst_messages) == (3, 3)
    c = store.read("chunks").filter("session_id = 'S-one'").orderBy("chunk_index").collect()
    assert [x.role for x in c] == ["exchange", "assistant", "user", "thinking", "tool_context", "thinking", "thinking"]  # the cut block is a little over one chunk
    assert c[0].content == f"[{lexicons.USER_LABEL}]: question one\n\n[{lexicons.ASSISTANT_LABEL}]: answer" and (c[0].line_start, c[0].line_end) == (4, 5)
    assert [x.metadata.get("exchange_idx") for x in c[:3]] == ["0", "1", "4"] and c[3].line_start == c[3].line_end == 5
    assert c[4].content == "create table\n" .strip() and c[5].content.startswith("...") and c[6].content.endswith("...")
    ids = [x.chunk_id for x in store.read("chunks").orderBy("session_id", "chunk_index").collect()]
    assert ids == list(range(8)) and store.read("vectors").count() == 8
    assert update(store, str(root), provider=embedder).indexed == 0
    with open(root / "-Users-me-proj" / "two.jsonl", "a", encoding="utf-8") as f:
        f.write("\n" + json.dumps(entry("assistant", "a1", 2, "reply with decidimos", "u1")))
    files = jsonl.with_status(jsonl.scan(spark, str(root), True), store.read("sessions"))
    assert {os.path.basename(x.file_path): (x.status, x.parent_session_id) for x in files.collect()} == {"one.jsonl": ("unchanged", None), "two.jsonl": ("changed", None), "x.jsonl": ("new", "parent-id")}
    assert update(store, str(root), provider=None).indexed == 1
    assert [x.role for x in store.read("chunks").filter("session_id = 'two'").collect()] == ["exchange"] and store.read("chunks").count() == 8 and store.read("vectors").count() == 7
    kept = store.read("vectors").join(store.read("chunks"), "chunk_id")
    assert {x.session_id for x in kept.select("session_id").collect()} == {"S-one"}
    backfill(store, embedder)
    assert store.read("vectors").count() == 8 and store.read("runs").count() == 3
    assert_index_is_whole(store)
    args = lambda *a: parser().parse_args(["--data", str(tmp_path / "index"), "--logs", str(root), *a])
    os.environ["RETROSPARK_DIMENSIONS"] = "16"
    assert "[Usuário]: **`question`** one" in run(spark, args("search", "question", "-f", "context", "-o", "clip.md")) and (tmp_path / "index" / "clips" / "clip.md").exists()
    found = json.loads(run(spark, args("search", "question one", "-f", "json", "-s", "S-")))
    assert found["results"] and {x["session_id"] for x in found["results"]} == {"S-one"}
    assert "1." in run(spark, args("search", "question")) and "ok  all" in run(spark, args("doctor"))
    assert "sessions: 2" in run(spark, args("status")) and "My title" in run(spark, args("sessions", "-p", "PROJ"))
    text = open(run(spark, args("export", "S-o")), encoding="utf-8").read()
    assert text.startswith("# My title") and text.index("question one") < text.index("root cause")
    delete_session(store, "two")
    assert store.read("chunks").count() == 7 and store.read("sessions").count() == 1
    assert_index_is_whole(store)
    from retrospark.streaming.ingest import follow

    follow(store, f"file://{root}/*", f"file://{tmp_path}/check", embedder).awaitTermination()
    assert store.read("sessions").count() == 2
    del os.environ["RETROSPARK_DIMENSIONS"]


def test_lines_of_splits(spark, tmp_path):
    """Splits of 1 KB give the rows of whole files: numbers of physical lines, blank, broken and very long ones among them."""
    rng = random.Random(8)
    root = tmp_path / "logs with + and %20"
    wanted = {}
    for f in range(5):
        lines = []
        for i in range(rng.randrange(1, 160)):
            kind = rng.random()
            lines.append("" if kind < 0.1 else "{broken" if kind < 0.2 else "[1, 2]" if kind < 0.25 else json.dumps(entry("user", f"u{f}-{i}", i % 60, "é漢" * rng.choice([1, 20, 20, 3000 if kind > 0.97 else 9])), ensure_ascii=False))
        path = root / f"p{f}" / f"s [{f}] {{+%41,}}.jsonl"
        log(path, *lines)
        if f % 2:
            path.write_text(path.read_text(encoding="utf-8") + "\n", encoding="utf-8")
        wanted |= {(str(path), n + 1): json.loads(x)["uuid"] for n, x in enumerate(lines) if x.startswith("{\"")}
    files = jsonl.scan(spark, str(root))
    assert {(r.file_path, r.file_size, r.file_hash) for r in files.collect()} == {(str(p), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in root.rglob("*.jsonl")}
    rows = lambda: {(r.file_path, r.line): r.uuid for r in jsonl.messages(jsonl.read(spark, str(root), files)).collect()}
    hashes = lambda: {r.file_path: r.file_hash for r in jsonl.scan(spark, str(root), whole_bytes=100).collect()}
    whole, grouped = rows(), hashes()
    assert whole == wanted and len(set(grouped.values())) == 5 and None not in grouped.values()
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "1024")
        assert jsonl._splits(spark, str(root)).select("file_path", "start").distinct().count() > 50
        assert rows() == wanted and hashes() == grouped
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    named = jsonl.NAMED_FILES
    jsonl.NAMED_FILES = 2  # from the folder, as there are too many to name
    try:
        assert rows() == wanted and jsonl.read(spark, str(root), files.filter("false")).count() == 0
    finally:
        jsonl.NAMED_FILES = named
    assert jsonl.scan(spark, str(tmp_path / "none")).count() == 0


def test_files_that_cannot_be_read(spark, tmp_path):
    """A file whose bytes don't match their checksum is reported; the rest is indexed; when it is mended, so is the index."""
    root = tmp_path / "logs"
    for name in ("good", "torn", "torn-large"):
        log(root / "p" / f"{name}.jsonl", *[entry("user", f"{name}{i}", i, f"{name} says {i}") for i in range(20)])
    for name in ("torn", "torn-large"):
        (root / "p" / f".{name}.jsonl.crc").write_bytes(b"crc\x00\x00\x00\x02\x00" + bytes(400))
    store = Store(spark, f"file://{tmp_path}/index")
    first = update(store, str(root))
    assert (first.scanned, first.indexed) == (3, 1) and first.errors == ["torn-large.jsonl: can't be read", "torn.jsonl: can't be read"]
    assert {r.session_id for r in store.read("sessions").collect()} == {"good"} and store.read("runs").first().errors == first.errors
    assert {r.file_path.rsplit("/", 1)[-1] for r in jsonl.scan(spark, str(root), whole_bytes=10).filter("file_hash is null").collect()} == {"torn.jsonl", "torn-large.jsonl"}
    for name in ("torn", "torn-large"):
        (root / "p" / f".{name}.jsonl.crc").unlink()
    second = update(store, str(root))
    assert (second.indexed, second.errors) == (2, []) and store.read("sessions").count() == 3
    assert_index_is_whole(store)


def assert_index_is_whole(store):
    """The text index of all segments is that of the chunks that are alive."""
    chunks = store.read("chunks")
    rows = lambda df, *c: sorted(df.select(*c).collect())
    assert rows(store.read("postings"), "term", "chunk_id", "col", "pos") == rows(X.postings(chunks), "term", "chunk_id", "col", "pos")
    assert rows(store.read("lengths"), "chunk_id", "n") == rows(X.document_lengths(chunks), "chunk_id", "n")
    impacts = impact_rows(store.read("impacts"), store._rows("dead_chunks", store.version()))
    assert rows(impacts, "term", "chunk_id", "f", "n") == rows(I.counts_by_chunk(X.postings(chunks), X.document_lengths(chunks)), "term", "chunk_id", "f", "n")
    assert rows(store.read("vocab"), "term", "doc", "cnt") == rows(X.vocabulary(X.postings(chunks)), "term", "doc", "cnt")


def test_updates_append(spark, tmp_path):
    """A session that grows adds its new chunks only; a bad file is reported; versions outlive a failing update."""
    root = tmp_path / "logs"
    for name in ("one", "two"):
        log(root / "p" / f"{name}.jsonl", *[entry(k, f"{name}{k}{i}", 2 * i + (k == "assistant"), f"{k} says {name} {i}", f"{name}user{i}" if k == "assistant" else None) for i in range(5) for k in ("user", "assistant")])
    (root / "p" / "bad.jsonl").write_bytes(b'{"type": "user", "x": "\xff\xfe"}')
    store, embedder = Store(spark, f"file://{tmp_path}/index"), HashingProvider(8)
    first = update(store, str(root), provider=embedder)
    assert (first.scanned, first.indexed, first.chunks) == (3, 2, 10) and first.errors == ["bad.jsonl: not UTF-8"]
    assert store.read("runs").first().errors == first.errors
    before = {(r.session_id, r.chunk_index): r.chunk_id for r in store.read("chunks").collect()}
    with open(root / "p" / "two.jsonl", "a", encoding="utf-8") as f:
        f.write("\n" + json.dumps(entry("user", "late", 30, "something new")))
    second = update(store, str(root))
    assert second.indexed == 1 and second.chunks == 1
    v = store.version()
    assert [(r.session_id, r.chunk_index) for r in spark.read.parquet(f"{store.root}/{v.segments[-1][0]}/chunks").collect()] == [("two", 5)]
    after = {(r.session_id, r.chunk_index): r.chunk_id for r in store.read("chunks").collect()}
    assert before.items() <= after.items() and len(after) == 11 and store.read("vectors").count() == 10
    assert {r.session_id: r.last for r in last_chunk_index(store.read("sessions"), store.read("chunks")).collect()} == {"one": 4, "two": 5}
    more = spark.createDataFrame([("none",), ("one",)], "session_id string")
    assert {r.session_id: r.last for r in last_chunk_index(more, store.read("chunks")).collect()} == {"one": 4, "none": -1}
    assert_index_is_whole(store)
    log(root / "p" / "one.jsonl", entry("user", "short", 1, "one is short now"))
    third = update(store, str(root), provider=embedder)
    assert third.chunks == 1 and store.read("chunks").filter("session_id = 'one'").count() == 1 and store.read("sessions").count() == 2
    assert_index_is_whole(store)
    with pytest.raises(RuntimeError, match="someone else"):  # two writers: the later one leaves what is there
        numbers = store._numbers
        store._numbers = lambda: numbers()[:-1]
        try:
            store.write({"runs": store.read("runs")}, v)
        finally:
            store._numbers = numbers
    assert store.read("chunks").count() == 7
    compact(store)
    assert len(store.version().segments) == 1 and store.read("chunks").count() == 7
    assert_index_is_whole(store)
    assert len(store._numbers()) == 2


def rows_scanned(df):
    """Rows that the scan of a plan without a shuffle gives on, when it has run."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_look_ups_pass_over_files(spark, tmp_path):
    """Thirty hits read a few of many files; many hits read all."""
    store = Store(spark, f"file://{tmp_path}/index")
    chunks = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("content"), F.lit("s").alias("session_id"), F.lit("user").alias("role"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        store.write({"chunks": chunks.orderBy(F.rand(1))}, store.version(), 40_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    table = store.read("chunks")
    assert table.select(F.input_file_name()).distinct().count() == 40
    wanted = [5, *range(20_000, 20_014), *range(39_000, 39_015)]
    hits = storage.settle(spark.createDataFrame([(0, i, 0.5, n + 1) for n, i in enumerate(wanted)], "query_id long, chunk_id long, score double, pos int"), "hits")
    found = storage.look_up(table, hits, "chunk_id")
    assert rows_scanned(found.select("content")) <= 4 * 1100  # of forty files, those of three places
    assert sorted(r.content for r in R.hydrate(hits, table, 100).collect()) == sorted(f"text {i}" for i in wanted)
    many = storage.settle(table.select("chunk_id"), "hits")
    assert storage.look_up(table, many, "chunk_id").count() == 40_000 and storage.look_up(table, storage.settle(hits.limit(0), "none"), "chunk_id").count() == 0
    assert storage.ranges([7, 1, 2, 3, 100, 101, 7], 3) == [(1, 3), (7, 7), (100, 101)] and storage.ranges([], 3) == [] and storage.ranges([9, 1], 1) == [(1, 9)]
    assert len(storage.ranges(list(range(0, 10_000, 7)))) == 64


def test_segments_due():
    """Which neighbours are merged, and that a chunk is written as often as the logarithm says whatever the updates' sizes."""
    assert indexer.due([100, 1, 1, 1], 4) is None and indexer.due([100, 1, 0, 1, 1], 4) == slice(1, 5)
    assert indexer.due([1, 1, 9, 16], 4) == slice(0, 4) and indexer.due([None, None, None, None, 1], 4) is None and indexer.due([], 4) is None
    rng = random.Random(3)
    for sizes in ([1] * 3000, [rng.choice([0, 1, 5, 40, 300]) for _ in range(3000)], [3000, *[1] * 3000], list(range(200))):
        segments, written, most = [], 0, 0
        for n in sizes:
            segments.append(n)
            written += n
            while (part := indexer.due(segments, 4)) is not None:
                written += sum(segments[part])
                segments[part] = [sum(segments[part])]
            most = max(most, len(segments))
        classes = math.ceil(math.log(sum(sizes), 4)) + 1
        assert most < 4 * classes and written <= sum(sizes) * (2 * classes + 1)


def test_bytes_of_a_hundred_updates(spark, tmp_path):
    """A hundred updates of one chunk each: what they write grows as n log n, and the last one's table is whole."""
    store = Store(spark, f"file://{tmp_path}/index")
    written, seen = [], set()
    for i in range(100):
        v = store.version()
        store.write({"chunks": spark.range(v.next_chunk, v.next_chunk + 1, 1, 1).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("x"), 2000 + (F.col("id") % 7).cast("int")).alias("content"))}, v, v.next_chunk + 1)
        indexer.merge(store)
        new = [s for s in store.version().segments if s[0] not in seen]
        seen |= {s[0] for s in store.version().segments}
        written.append(sum(s[2] for s in new))
    assert store.read("chunks").count() == 100 and sorted(r.chunk_id for r in store.read("chunks").select("chunk_id").collect()) == list(range(100))
    assert len(store.version().segments) < 4 * 5 and sum(store.version().sizes()) == 100
    assert sum(written) <= 100 * 5 and sorted(written)[75] <= 4  # three of four updates write four chunks at most
    assert len(store._numbers()) == 2 and len(list((tmp_path / "index").glob("segment-*"))) <= 30


def test_merging_keeps_what_is_gone(spark, tmp_path, monkeypatch):
    """Updates, shrinking files and deletions over segments that are merged in part: the index stays that of its chunks."""
    monkeypatch.setattr(indexer, "FANOUT", 2)
    root, store, embedder = tmp_path / "logs", Store(spark, f"file://{tmp_path}/index"), HashingProvider(8)
    say = lambda name, n, more="": log(root / "p" / f"{name}.jsonl", *[entry("user", f"{name}{i}", i, f"{name} says {i} {more}") for i in range(n)])
    say("old", 30)
    update(store, str(root), provider=embedder)
    say("one", 3)
    update(store, str(root), provider=embedder)
    say("one", 4)
    say("old", 2, "other words")  # names chunks of the first segment as gone
    update(store, str(root))
    say("two", 3)
    update(store, str(root), provider=embedder)
    delete_session(store, "one")
    indexer.merge(store)
    v = store.version()
    assert 1 < len(v.segments) < 5 and indexer.due(v.sizes()) is None and any("dead_chunks" in s[1] for s in v.segments[1:])
    assert_index_is_whole(store)
    assert {(r.session_id, r.n) for r in store.read("chunks").groupBy("session_id").agg(F.count("*").alias("n")).collect()} == {("old", 2), ("two", 3)}
    assert {r.session_id for r in store.read("sessions").collect()} == {"old", "two"} and store.read("sessions").count() == 2
    # A search reads the vocabulary's rows that it names only, whatever the segments.
    index = store.index()
    known = index.vocab.filter(F.col("term").isin(["says", "other"]))
    assert len(v.paths("vocab")) > 1 and "In(term" in known._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    assert {r.term: r.doc for r in known.collect()} == {"says": 5, "other": 2}
    asked = spark.createDataFrame([(0, "words says")], "query_id long, text string")
    assert {r.session_id for r in keyword_search(index, asked, 9).collect()} == {"old", "two"}
    compact(store)
    assert len(store.version().segments) == 1 and not store.version().paths("dead_chunks")
    assert_index_is_whole(store)


def test_renderings():
    assert "Nenhum resultado" in admin.result_markdown([], "q", 3, 9) and "(3 sessões indexadas, 9 chunks no banco)" in admin.result_markdown([], "q", 3, 9)
    row = {"content": "about chromadb", "session_id": "12345678-9", "score": 0.5, "sources": ["vector", "fts5"], "ts": datetime.datetime(2024, 1, 2, 3, 4), "title": "t", "project_label": "p"}
    text = admin.result_markdown([row, row], "chroma", 1, 2, [{"original": "chroma", "expanded": ["chromadb"], "type": "fuzzy"}])
    assert "fuzzy: chroma → chromadb" in text and "### 2. p — t" in text and "VECTOR + FTS5" in text and "**`chromadb`**" in text and "02/01/2024 03:04" in text
    assert clip_path("/c", "Why, sqlite vec?", "-auto-", datetime.date(2024, 1, 2)) == "/c/2024-01-02_why-sqlite-vec.md" and clip_path("/c", "q", "x.md", datetime.date(2024, 1, 2)) == "/c/x.md"


def test_providers():
    assert provider("none") is None and provider("hashing", 8).embed(["a b"], "query").shape == (1, 8)
    told = FunctionProvider(lambda texts: [[len(t), 0.0] for t in texts], 2, "m", "ask: ")
    assert told.embed(["ab"], "query")[0][0] == 7 and told.embed(["ab"], "document")[0][0] == 2
    with pytest.raises(ValueError):
        FunctionProvider(lambda texts: [[1.0]], 2, "m").embed(["a"], "query")


def test_providers_over_http(spark):
    """A server of each kind: whole batches, the instruction for queries only, the key, and what is refused."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            rows = [[float(len(t)), 1.0, 2.0] for t in body["input"]]
            answer = json.dumps({"embeddings": rows} if self.path == "/api/embed" else {"data": [{"embedding": r} for r in rows]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    local = provider("local", 2, model="m", base_url=url, instruction="find it")
    assert local.embed(["ab", "c"], "document").tolist() == [[2.0, 1.0], [1.0, 1.0]]
    local.embed(["ab"], "query")
    assert seen[-1][2] == {"model": "m", "input": ["Instruct: find it\nQuery: ab"]} and seen[-2][2]["input"] == ["ab", "c"]
    api = provider("api", key="k", model="m", base_url=url, dimensions=3)
    assert api.embed(["abc"], "query").tolist() == [[3.0, 1.0, 2.0]] and seen[-1][:2] == ("/embeddings", "Bearer k")
    rows = embed(spark.createDataFrame([(0, "four"), (1, None)], "chunk_id long, content string"), api, "content").collect()
    assert sorted(r.embedding for r in rows) == [[0.0, 1.0, 2.0], [4.0, 1.0, 2.0]]
    assert provider("api", key="", model="m", base_url=url) is None and provider("local", 5, model="m", base_url=url) is None
    server.shutdown()
    assert provider("local", 2, model="m", base_url="http://127.0.0.1:9", timeout=1.0) is None


def test_export_of_all_sessions(spark, tmp_path):
    """A file for each session, under eight characters of its name or, where these are not its own, the whole."""
    sessions = S.session_metadata(queries.messages(spark, SF)).withColumns({"project_label": F.lit("p"), "started_at": F.lit(None).cast("timestamp")})
    chunks = queries.message_chunks(spark, SF).withColumnRenamed("line", "chunk_index")
    admin.export_all(sessions, chunks, str(tmp_path / "all"))
    want = {r.session_id: r.markdown for r in admin.session_markdown(sessions, chunks).collect()}
    got = {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / "all").iterdir() if not p.name.startswith(".")}
    assert got == {f"{i}.md": t for i, t in want.items()} and len(got) == sessions.count()
    own = lambda df: df.withColumn("session_id", F.regexp_replace("session_id", "conv-0*(?=.)", "s/"))
    admin.export_all(own(sessions), own(chunks), f"file://{tmp_path}/own")
    assert {p.name for p in (tmp_path / "own").iterdir() if not p.name.startswith(".")} == {f"s_{int(i[5:])}.md" for i in want}
    with pytest.raises(Exception, match="exists already"):
        admin.export_all(own(sessions), own(chunks), str(tmp_path / "own"))
    # A task that fails leaves nothing: neither the folder nor what others have written for it.
    rows = spark.range(0, 40, 1, 8).select(F.concat("id", F.lit(".md")).alias("file_name"), F.when(F.col("id") == 37, F.raise_error(F.lit("torn"))).otherwise("t").cast("string").alias("text"))
    with pytest.raises(Exception, match="torn"):
        write_folder(rows, str(tmp_path / "torn"))
    assert {p.name for p in tmp_path.iterdir()} == {"all", "own"}


def test_registry():
    import __spark_entry__ as entry

    assert queries.QUERIES.keys() <= entry.queries().keys() and set(entry.oracle_sql()) <= set(entry.queries())


def test_chunk_ids_are_dense(spark):
    rows = spark.createDataFrame([(f"s{i % 7}", i) for i in range(100)], "session_id string, chunk_index int")
    got = S.with_chunk_ids(rows).orderBy("session_id", "chunk_index").collect()
    assert [r.chunk_id for r in got] == list(range(100))
