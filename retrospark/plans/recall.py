"""Searches over an index, for any number of queries at once.

queries: query_id, text, and per query limit and q (vector) where there are such. An Index holds the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrospark.config import Settings
from retrospark.operators import expand as E
from retrospark.operators import ranking as R
from retrospark.operators.impact import impact_scores
from retrospark.operators.knn import knn
from retrospark.operators.text_index import bm25, document_lengths, few_terms, postings, top_k, vocabulary_of
from retrospark.operators.text_index import like as matches
from retrospark.storage import look_up, rows_of, settle


@dataclass
class Index:
    chunks: DataFrame
    sessions: DataFrame | None
    vectors: DataFrame
    postings: DataFrame
    lengths: DataFrame
    vocab: DataFrame
    impacts: DataFrame | None = None  # blocks of postings by impact, and the chunks in them that are gone
    dead: DataFrame | None = None
    terms: DataFrame | None = None  # the vocabulary's gram index

    def known(self, queries: DataFrame, settings: Settings) -> DataFrame:
        """The vocabulary's rows that queries name, read once for all that ask."""
        return E.known_terms(self.vocab, E.asked_words(queries, settings))

    def expand(self, queries: DataFrame, settings: Settings, known: DataFrame | None = None) -> DataFrame:
        """A few rows for each query, read by several branches of a plan: variants are looked for once."""
        return settle(E.expand(queries, self.vocab, settings, self.terms, self.known(queries, settings) if known is None else known), "expanded")

    @classmethod
    def of(cls, chunks: DataFrame, vectors: DataFrame, sessions: DataFrame | None = None) -> Index:
        p = postings(chunks)
        return cls(chunks, sessions, vectors, p, document_lengths(chunks), vocabulary_of(chunks))


def vector_search(index: Index, queries: DataFrame, k: int, session: str | None = None, settings: Settings = Settings(), prefilter: bool = False) -> DataFrame:
    """The k nearest chunks of each query: of three times as many, those of the session; with prefilter, from the session only."""
    vectors, queries = index.vectors, settle(queries, "queries")
    if prefilter and session is not None:
        vectors = vectors.join(index.chunks.filter(F.col("session_id") == session).select("chunk_id"), "chunk_id", "left_semi")
    asked = queries.filter(F.col("q").isNotNull()).select("query_id", "q")
    return R.hydrate(knn(vectors, asked, 3 * k, settings.metric), index.chunks, k, session)


def keyword_search(index: Index, queries: DataFrame, k: int, session: str | None = None, settings: Settings = Settings(), corrected: bool = False, expanded: DataFrame | None = None) -> DataFrame:
    """The k best chunks of each query by BM25. score is 1 / (1 + rank), which falls as the match gets better; corrected, r / (1 + r)."""
    queries = settle(queries, "queries")
    expanded = index.expand(queries, settings) if expanded is None else settle(expanded, "expanded")
    bare = settle(E.bare_phrases(queries, expanded), "bare")
    some = bare.select("query_id", F.posexplode("phrases").alias("phrase_no", "form")).select("query_id", "phrase_no", E.T.index_terms(F.col("form")).alias("terms"))
    phrases = E.phrases(expanded).unionByName(some)
    readable = settle(phrases.join(E.invalid(expanded), "query_id", "left_anti"), "phrases")
    # Stored postings are in order of terms: files and row groups without a term that is asked for are passed over.
    if index.impacts is not None:
        scores = impact_scores(index.impacts, index.postings, index.lengths, index.vocab, readable, 3 * k, dead=index.dead)
    else:
        terms = few_terms(readable)
        scores = bm25(index.postings if terms is None else index.postings.filter(F.col("term").isin(terms)), index.lengths, readable)
    best = top_k(scores, 3 * k, F.desc("bm25"), F.col("chunk_id"))
    score = F.col("bm25") / (1 + F.col("bm25")) if corrected else 1 / (1 + F.col("bm25"))
    found = R.hydrate(best.select("query_id", "chunk_id", F.col("bm25").alias("distance"), score.alias("score"), "pos"), index.chunks, k, session)
    # Queries that can't be read as a match, or have nothing to match, are looked up as they are.
    broken = E.invalid(expanded).join(queries, "query_id").select("query_id", E.T.normalize_separators(F.col("text")).alias("needle"))
    broken = broken.union(bare.filter("phrases is null").select("query_id", "needle"))
    few, rest = rows_of(expanded), rows_of(bare)
    if few is not None and rest is not None and not any('"' in r.token for r in few) and not any(r.phrases is None for r in rest):
        return found
    rows = index.chunks if session is None else index.chunks.filter(F.col("session_id") == session)
    like = rows.join(broken, matches(F.col("content"), F.col("needle"))).drop("needle")
    like = top_k(like, k, F.col("chunk_id")).withColumns({"distance": F.lit(1.0), "score": F.lit(0.5)})
    return found.unionByName(like.select(*found.columns))


def hybrid_search(index: Index, queries: DataFrame, k: int, session: str | None = None, settings: Settings = Settings(), weights: DataFrame | None = None, corrected: bool = False) -> DataFrame:
    """query_id, place, score, sources and the chunk: both searches with twice as many results, fused."""
    queries = settle(queries, "queries")
    known = index.known(queries, settings)
    weights = settle(E.classify(queries, index.vocab, settings, known), "weights") if weights is None else weights
    fused = R.fuse(vector_search(index, queries, 2 * k, session, settings), keyword_search(index, queries, 2 * k, session, settings, corrected, index.expand(queries, settings, known)), weights, settings)
    return top_k(fused, k, F.desc("score"), F.col("first"), name="place").drop("first")


def recall(index: Index, queries: DataFrame, limit: int = 5, session: str | None = None, as_of: Column | None = None, settings: Settings = Settings(), corrected: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """query_id, rank, score, sources, chunk and session columns: hybrid search, role weight, decay, diversity."""
    as_of = F.current_timestamp() if as_of is None else as_of
    queries = settle(queries, "queries")
    pool = settle(hybrid_search(index, queries, 3 * limit, session, settings, weights, corrected), "pool", costly=True)
    weighted = pool.withColumn("score", F.col("score") * R.role_weight(F.col("role")))
    aged = weighted.withColumn("score", R.decay(F.col("score"), F.col("ts"), as_of, R.architectural(F.col("content")), settings.half_life_days))
    vectors = look_up(index.vectors, pool, "chunk_id").select("chunk_id", F.col("embedding").alias("v"))
    chosen = R.mmr(aged.join(vectors, "chunk_id", "left").withColumn("limit", F.lit(limit)), "limit", settings.mmr_lambda)
    if index.sessions is None:
        return chosen
    names = [c for c in ("title", "project_label") if c in index.sessions.columns]
    return chosen.join(index.sessions.select("session_id", *names), "session_id")


def query_info(queries: DataFrame, vocab: DataFrame, settings: Settings = Settings(), terms: DataFrame | None = None) -> DataFrame:
    """query_id, normalized_query, expansions (array of struct(original, expanded, type)), search_mode."""
    e = E.expand(queries, vocab, settings, terms).filter("kind <> 'literal'").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("token").alias("original"), "expanded", F.col("kind").alias("type")))), lambda s: s.dropFields("n")).alias("expansions"))
    mode = E.classify(queries, vocab, settings).select("query_id", F.col("mode").alias("search_mode"))
    return queries.select("query_id", E.T.normalize_separators(F.col("text")).alias("normalized_query")).join(e, "query_id", "left").join(mode, "query_id")


def resolve_sessions(sessions: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, session_id: for each prefix the first session whose identifier begins so; the prefix itself if none does or it
    is a whole identifier. Sessions meet prefixes by their first characters, for each length that a prefix has."""
    asked = prefixes.select("prefix", F.length("prefix").alias("n")).distinct()
    lengths = sorted(r.n for r in asked.filter("n < 36").select("n").distinct().collect())  # under 36 numbers
    starts = sessions.select("session_id", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n"))
    starts = starts.filter(F.length("session_id") >= F.col("n")).groupBy("n", F.substr("session_id", F.lit(1), F.col("n")).alias("prefix")).agg(F.min("session_id").alias("first"))
    return asked.join(starts, ["n", "prefix"], "left").select("prefix", F.coalesce("first", "prefix").alias("session_id"))


def resolve_session(sessions: DataFrame, prefix: str) -> str:
    """resolve_sessions() for one prefix."""
    return resolve_sessions(sessions, sessions.sparkSession.createDataFrame([(prefix,)], "prefix string")).first().session_id
