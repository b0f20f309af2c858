"""Postings, vocabulary and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrospark.functions import text as T
from retrospark.storage import materialize, rows_of

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Terms that a plan may name, so that a scan can look for them.
NAMED_TERMS = 1000
#: Phrases that a plan may hold, so that each row counts them in its own texts.
NAMED_PHRASES = 1000


def postings(chunks: DataFrame, *columns: str) -> DataFrame:
    """term, chunk_id, col, pos: every token of the indexed columns. A row for each token, without a shuffle."""
    columns = columns or ("content", "session_id", "role")
    cols = F.array(*[F.struct(F.lit(c).alias("col"), T.index_terms(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("terms")) for c in columns])
    each = chunks.select("chunk_id", F.explode(cols).alias("c"))
    return each.select("chunk_id", F.col("c.col").alias("col"), F.posexplode("c.terms").alias("pos", "term")).select("term", "chunk_id", "col", "pos")


def all_terms(columns: tuple[str, ...]) -> Column:
    """The tokens of the indexed columns of a row, one column after the other."""
    columns = columns or ("content", "session_id", "role")
    return F.concat(*[T.index_terms(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def document_lengths(chunks: DataFrame, *columns: str) -> DataFrame:
    """chunk_id, n: tokens over all indexed columns."""
    return chunks.select("chunk_id", F.size(all_terms(columns)).alias("n"))


def terms_by_chunk(chunks: DataFrame, *columns: str) -> DataFrame:
    """chunk_id, n (tokens over all indexed columns), terms (array of term and f, its occurrences). Each text is cut once; its terms
    are sorted, and where one begins and the next begins is how often it stands there, so nothing is shuffled."""
    terms = chunks.select("chunk_id", F.sort_array(all_terms(columns)).alias("terms"))
    begins = F.transform("terms", lambda t, i: F.when((i == 0) | (F.get("terms", i - 1) != t), i))
    cut = terms.select("chunk_id", "terms", F.size("terms").alias("n"), F.array_compact(begins).alias("at"))
    runs = F.transform("at", lambda i, j: F.struct(F.get("terms", i).alias("term"), (F.coalesce(F.get("at", j + 1), F.col("n")) - i).alias("f")))
    # Written, as a plan that goes on with single fields of the terms would compute them again for each.
    return materialize(cut.select("chunk_id", "n", runs.alias("terms")), "terms")


def counts_of_terms(rows: DataFrame) -> DataFrame:
    """term, chunk_id, f (occurrences), n (the chunk's length), from what terms_by_chunk() gives."""
    return rows.select("chunk_id", "n", F.explode("terms").alias("t")).select("t.term", "chunk_id", "t.f", "n")


def scan_for(chunks: DataFrame, phrases: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of chunks that have no index: each text is cut to tokens once, and only tokens that a phrase
    has leave their row. Where there are too many such terms to name them, all tokens do."""
    terms = few_terms(phrases)
    if terms is None:
        return postings(chunks, *columns), document_lengths(chunks, *columns)
    columns = columns or ("content", "session_id", "role")
    parts = [T.index_terms(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"terms_{i}") for i, c in enumerate(columns)]
    hits = [F.filter(F.transform(f"terms_{i}", lambda t, at: F.struct(at.alias("pos"), t.alias("term"))), lambda h: h["term"].isin(terms)).alias("hits") for i in range(len(columns))]
    n = sum((F.size(f"terms_{i}") for i in range(1, len(columns))), F.size("terms_0"))
    each = F.array(*[F.struct(F.lit(c).alias("col"), h) for c, h in zip(columns, hits, strict=True)])
    rows = materialize(chunks.select("chunk_id", *parts).select("chunk_id", n.alias("n"), F.filter(each, lambda c: F.size(c["hits"]) > 0).alias("found")), "scanned")
    found = rows.select("chunk_id", F.explode("found").alias("c")).select("chunk_id", F.col("c.col").alias("col"), F.explode("c.hits").alias("h"))
    return found.select(F.col("h.term").alias("term"), "chunk_id", "col", F.col("h.pos").alias("pos")), rows.select("chunk_id", "n")


def scan_bm25(chunks: DataFrame, phrases: DataFrame, *columns: str) -> DataFrame:
    """As bm25(), of chunks that have no index. Each row counts the phrases in its own texts and adds up its own scores, so
    that nothing moves but the numbers of chunks that have a phrase, and a task holds a row at a time however many hits a
    corpus has. Where phrases are too many to be held by a plan, as bm25() of scan_for()."""
    wanted = phrases.filter(F.size("terms") > 0).select("query_id", "phrase_no", "terms")
    asked = wanted.limit(NAMED_PHRASES + 1).collect()
    terms = sorted({t for r in asked for t in r.terms})
    if len(asked) > NAMED_PHRASES or len(terms) > NAMED_TERMS:
        return bm25(*scan_for(chunks, phrases, *columns), phrases)
    if not asked:
        return chunks.select(F.lit(None).cast(phrases.schema["query_id"].dataType).alias("query_id"), "chunk_id", F.lit(0.0).alias("bm25")).limit(0)
    columns = columns or ("content", "session_id", "role")
    names = [f"terms_{i}" for i in range(len(columns))]
    cut = chunks.select("chunk_id", *[T.index_terms(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(t) for c, t in zip(columns, names, strict=True)])
    places = [F.array_compact(F.transform(t, lambda x, i: F.when(x.isin(terms), i))).alias(f"at_{t}") for t in names]
    cut = cut.select("chunk_id", *names, *places)
    literal = F.array(*[F.struct(F.lit(i).alias("no"), F.array(*map(F.lit, r.terms)).alias("terms")) for i, r in enumerate(asked)])

    def standing(column: str, p: Column) -> Column:
        stands = lambda i: (F.get(column, i) == F.get(p, F.lit(0))) & ((F.size(p) == 1) | (F.slice(column, i + 1, F.size(p)) == p))
        return F.size(F.filter(f"at_{column}", stands))

    found = F.transform(literal, lambda p: F.struct(p["no"].alias("no"), sum((standing(t, p["terms"]) for t in names[1:]), standing(names[0], p["terms"])).alias("f")))
    n = sum((F.size(t) for t in names[1:]), F.size(names[0]))
    # Places are named twice: what is named once, Spark would compute for each phrase.
    some = sum((F.size(f"at_{t}") for t in names[1:]), F.size(f"at_{names[0]}")) > 0
    found = F.when(some, found)
    rows = materialize(cut.select("chunk_id", n.alias("n"), F.filter(found, lambda x: x["f"] > 0).alias("found")), "scanned")
    stats = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean"))
    with_it = rows.select(F.explode("found.no").alias("no")).groupBy("no").agg(F.count(F.lit(1)).alias("with_it"))
    weights = with_it.join(F.broadcast(stats), F.lit(True)).select("no", "mean", idf(F.col("n_docs"), F.col("with_it")).alias("idf")).collect()
    known, mean = {r.no: r.idf for r in weights}, weights[0].mean if weights else 1.0
    weight, owner = F.array(*[F.lit(known.get(i, 0.0)) for i in range(len(asked))]), F.array(*[F.lit(r.query_id) for r in asked])
    part = lambda x: F.get(weight, x["no"]) * x["f"] * (K1 + 1) / (x["f"] + K1 * (1 - B + B * F.col("n") / mean))
    each = rows.select("chunk_id", "n", "found", F.explode(F.array_distinct(F.transform("found", lambda x: F.get(owner, x["no"])))).alias("query_id"))
    score = F.aggregate(F.filter("found", lambda x: F.get(owner, x["no"]) == F.col("query_id")), F.lit(0.0), lambda a, x: a + part(x))
    return each.select("query_id", "chunk_id", score.alias("bm25"))


def few_terms(phrases: DataFrame) -> list[str] | None:
    """The terms of all phrases, if they are few enough to be named in a plan."""
    if (few := rows_of(phrases)) is not None:
        terms = {t for r in few for t in r.terms}
        return sorted(terms) if len(terms) <= NAMED_TERMS else None
    rows = phrases.select(F.explode("terms").alias("t")).distinct().limit(NAMED_TERMS + 1).collect()
    return sorted(r.t for r in rows) if len(rows) <= NAMED_TERMS else None


def vocabulary(postings: DataFrame) -> DataFrame:
    """term, doc (chunks that have it), cnt (occurrences)."""
    by_chunk = postings.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("c"))
    return by_chunk.groupBy("term").agg(F.count(F.lit(1)).alias("doc"), F.sum("c").alias("cnt"))


def vocabulary_of_counts(counts: DataFrame) -> DataFrame:
    """As vocabulary, from rows (term, chunk_id, f) of which there is one for each term of a chunk."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("doc"), F.sum("f").alias("cnt"))


def vocabulary_of(chunks: DataFrame, *columns: str) -> DataFrame:
    """As vocabulary, from chunks: each text is cut once, its terms are sorted and tell which is the first of its kind, and
    tasks add up before anything moves."""
    rows = chunks.select(F.array_sort(all_terms(columns)).alias("terms"))
    told = F.transform("terms", lambda t, i: F.struct(t.alias("term"), F.when((i > 0) & (F.get("terms", i - 1) == t), 0).otherwise(1).alias("first")))
    each = rows.select(F.explode(told).alias("t")).select("t.term", "t.first")
    return each.groupBy("term").agg(F.sum("first").alias("doc"), F.count(F.lit(1)).alias("cnt"))


def idf(n_docs: Column, with_it: Column) -> Column:
    plain = F.log((n_docs - with_it + 0.5) / (with_it + 0.5))
    return F.when(plain > 0, plain).otherwise(F.lit(LEAST_IDF))


def phrase_counts(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, phrase_no, chunk_id, f: how often a phrase stands in a chunk. Of a phrase of one term, its occurrences;
    others are found where their terms stand in a row in one column."""
    asked = phrases.filter(F.size("terms") > 0).select("query_id", "phrase_no", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term"))
    hits = postings.join(asked, "term")
    single = hits.filter("size = 1").groupBy("query_id", "phrase_no", "chunk_id").agg(F.count(F.lit(1)).alias("f"))
    runs = hits.filter("size > 1").withColumn("start", F.col("pos") - F.col("off")).groupBy("query_id", "phrase_no", "chunk_id", "col", "start", "size").agg(F.count(F.lit(1)).alias("k")).filter("k = size")
    several = runs.groupBy("query_id", "phrase_no", "chunk_id").agg(F.count(F.lit(1)).alias("f"))
    return single.unionByName(several)


def bm25(postings: DataFrame, lengths: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, chunk_id, bm25. phrases: query_id, phrase_no, terms (array); repeated phrases add up.

    Postings are filtered by the queries' terms first. The corpus numbers come from one aggregate over the lengths.
    """
    f = phrase_counts(postings, phrases)
    with_it = f.groupBy("query_id", "phrase_no").agg(F.count(F.lit(1)).alias("with_it"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean"))
    scored = f.join(with_it, ["query_id", "phrase_no"]).join(lengths, "chunk_id").join(F.broadcast(stats), F.lit(True))
    part = idf(F.col("n_docs"), F.col("with_it")) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return scored.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("bm25"))


def top_k(rows: DataFrame, k: Column | int, *order: Column, by: str = "query_id", name: str = "pos") -> DataFrame:
    """The first k rows of each query, numbered from 1; tasks keep their own first k before rows move."""
    k = F.lit(k) if isinstance(k, int) else k
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(name) <= k)


def like(text: Column, needle: Column) -> Column:
    """Whether a text holds another; only A-Z ignore case, and % and _ stand for anything."""
    return F.like(T.ascii_lower(text), F.concat(F.lit("%"), F.replace(T.ascii_lower(needle), F.lit("\\"), F.lit("\\\\")), F.lit("%")))


def like_search(chunks: DataFrame, needle: str, k: int, session: str | None = None) -> DataFrame:
    """The first k chunks, by number, that hold a text; only A-Z ignore case. Score 0.5, distance 1."""
    rows = chunks if session is None else chunks.filter(F.col("session_id") == session)
    found = rows.filter(like(F.col("content"), F.lit(needle)))
    return found.orderBy("chunk_id").limit(k).withColumns({"distance": F.lit(1.0), "score": F.lit(0.5)})
