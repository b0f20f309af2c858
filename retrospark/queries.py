"""One query for each operator, over the shared tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrospark import lexicons
from retrospark.embeddings import HashingProvider, embed_with_cache
from retrospark.functions import text as T
from retrospark.functions import vectors as V
from retrospark.operators import expand as E
from retrospark.operators import ranking as R
from retrospark.operators import sessions as S
from retrospark.operators import text_index as X
from retrospark.operators.impact import impact_blocks, impact_scores, vocabulary_of_blocks
from retrospark.operators.knn import knn
from retrospark.plans import admin
from retrospark.plans.recall import Index, hybrid_search, query_info, recall, resolve_sessions
from retrospark.sources import jsonl
from retrospark.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-01-31 00:00:00"
# Queries of the searches: one word, several, a phrase, abbreviations, typos, and descriptive ones.
ASKED = [(0, "clown trash"), (1, "why is the clown here"), (2, "db-msg"), (3, "Loser MORON scum worthless"), (4, "idoit stupd pathetik"), (5, "PLN"), (6, "de")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("session_id"), F.col("lang").alias("role"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.conversation_messages(table(spark, sf_dir, "conversations"))


def message_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message a chunk, numbered as the vectors are."""
    rows = messages(spark, sf_dir).select("session_id", "line", F.col("type").alias("role"), F.col("text").alias("content"), T.parse_timestamp(F.col("ts_text")).alias("ts"))
    return S.with_chunk_ids(rows, "session_id", "line")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def asked(spark: SparkSession, sf_dir: str, text: str | None = None) -> DataFrame:
    """The queries, each with the vector of the row of its number."""
    rows = spark.createDataFrame(ASKED if text is None else [(0, text)], "query_id long, text string")
    return rows.join(vectors(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "left")


SESSION = "'conv-' || lpad(conv_id::VARCHAR, 8, '0')"
MESSAGES = f"""m AS (SELECT {SESSION} AS session_id, conv_id, turn, turn + 1 AS line, role, trim(coalesce(text, ''), E' \\t\\n\\r') AS text,
  strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%dT%H:%M:%SZ') AS ts_text FROM conversations)"""
TERMS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
TOKENS = f"tok AS (SELECT doc_id AS chunk_id, unnest({TERMS.format('text')}) AS term, generate_subscripts({TERMS.format('text')}, 1) - 1 AS pos FROM documents)"
LENS = f"lens AS (SELECT doc_id AS chunk_id, len({TERMS.format('text')}) + len({TERMS.format('source')}) + len({TERMS.format('lang')}) AS n FROM documents)"


def chunk_sql(source: str) -> str:
    """SQL that cuts rows (id, text) of `source` into pieces: id, k, piece."""
    return f"""cuts AS (
      SELECT id, text, 0 AS pos, 0 AS step FROM {source} WHERE length(text) > 1500
      UNION ALL
      SELECT id, text, CASE WHEN stop < length(text) THEN stop - 200 ELSE length(text) END, step + 1 FROM (
        SELECT *, CASE WHEN pos + 1500 < length(text) AND contains(w, chr(10) || chr(10)) AND pos + length(regexp_extract(w, '^((?s:.*))\\n\\n', 1)) > pos + 500 THEN pos + length(regexp_extract(w, '^((?s:.*))\\n\\n', 1)) ELSE pos + 1500 END AS stop
        FROM (SELECT *, substr(text, pos + 1, 1500) AS w FROM cuts WHERE pos < length(text)))),
    ends AS (SELECT id, step, trim(substr(text, pos + 1, CASE WHEN pos + 1500 < length(text) AND contains(substr(text, pos + 1, 1500), chr(10) || chr(10)) AND length(regexp_extract(substr(text, pos + 1, 1500), '^((?s:.*))\\n\\n', 1)) > 500 THEN length(regexp_extract(substr(text, pos + 1, 1500), '^((?s:.*))\\n\\n', 1)) ELSE 1500 END), E' \\t\\n\\r') AS piece FROM cuts WHERE pos < length(text)),
    pieces AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY step) - 1 AS k, piece FROM ends WHERE piece <> '' UNION ALL SELECT id, 0, text FROM {source} WHERE length(text) <= 1500)"""


SECTION = """CASE WHEN p IS NULL THEN substr(t, 1, 1500) ELSE
  CASE WHEN p > 751 THEN '...' ELSE '' END || trim(substr(t, greatest(0, p - 751) + 1, least(length(t), p + 749) - greatest(0, p - 751)), E' \\t\\n\\r\\f\\v') || CASE WHEN p + 749 < length(t) THEN '...' ELSE '' END END"""
EARLIEST = "least(" + ", ".join(f"nullif(instr(lower(t), '{m}'), 0)" for m in lexicons.SELECTIVE_MARKERS) + ")"


# ---------------------------------------------------------------- vectors


# Queries of the vector searches: every fiftieth row, against all rows.
EVERY = 50
NEAR = "SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.label, {d} AS d FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {order}, v.vec_id) <= 15"
NEAR_L2 = NEAR.format(d="list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[])", order="d")
NEAR_COSINE = NEAR.format(d="1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])", order="round(d, 9)")


def every_fiftieth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"SELECT query_id, chunk_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM ({NEAR_L2})")
def knn_l2(spark, sf_dir):
    found = knn(vectors(spark, sf_dir), every_fiftieth(spark, sf_dir), 15)
    return found.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"SELECT query_id, chunk_id, abs(round(d, 6)) AS distance FROM ({NEAR_COSINE})")
def knn_cosine(spark, sf_dir):
    return knn(vectors(spark, sf_dir), every_fiftieth(spark, sf_dir), 15, "cosine").select("query_id", "chunk_id", F.abs(F.round("distance", 6)).alias("distance"))


@query(f"SELECT query_id, chunk_id, round(d, 6) AS distance FROM ({NEAR_L2}) WHERE label = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) <= 5")
def knn_session_postfilter(spark, sf_dir):
    v = vectors(spark, sf_dir)
    hits = knn(v, every_fiftieth(spark, sf_dir), 15)
    found = R.hydrate(hits, v.select("chunk_id", F.col("label").cast("string").alias("session_id")), 5, "1")
    return found.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pairwise_cosine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    after = v.select((F.col("chunk_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return v.withColumnRenamed("chunk_id", "vec_id").join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


JACCARD = "WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM conversations) SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 6) AS jaccard FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"


@query(JACCARD)
def pairwise_jaccard(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", V.token_set(F.col("text")).alias("w"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("b"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(V.jaccard(F.col("w"), F.col("b")), 6).alias("jaccard"))


# ---------------------------------------------------------------- sessions


@query(f"WITH {MESSAGES} SELECT session_id, 'Sessão ' || substr(session_id, 1, 8) AS title, min(ts_text) FILTER (role = 'system') AS started_ts_text, max(ts_text) AS ended_ts_text, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS asst_messages FROM m GROUP BY session_id")
def session_meta(spark, sf_dir):
    return S.session_metadata(messages(spark, sf_dir))


PAIRS = f"""{MESSAGES}, pairs AS (
  SELECT u.session_id, u.turn AS ut, a.turn AS asst FROM m u JOIN m a ON a.session_id = u.session_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
  UNION ALL SELECT session_id, turn, NULL FROM m u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM m a WHERE a.session_id = u.session_id AND a.turn = u.turn + 1 AND a.role = 'assistant')
  UNION ALL SELECT session_id, NULL, turn FROM m a WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM m u WHERE u.session_id = a.session_id AND u.turn = a.turn - 1 AND u.role = 'user')),
  ex AS (SELECT p.session_id, row_number() OVER (PARTITION BY p.session_id ORDER BY coalesce(ut, asst)) - 1 AS exchange_idx, ut + 1 AS line_start, asst + 1 AS line_end, coalesce(u.text, '') AS u, coalesce(a.text, '') AS a, coalesce(u.ts_text, a.ts_text) AS ts_text
         FROM pairs p LEFT JOIN m u ON u.session_id = p.session_id AND u.turn = p.ut LEFT JOIN m a ON a.session_id = p.session_id AND a.turn = p.asst)"""
EXCHANGES = f"""{PAIRS}, exch AS (SELECT session_id, exchange_idx, CASE WHEN u <> '' AND a <> '' THEN 'exchange' WHEN u <> '' THEN 'user' ELSE 'assistant' END AS role,
  concat_ws(chr(10) || chr(10), CASE WHEN u <> '' THEN '[{lexicons.USER_LABEL}]: ' || u END, CASE WHEN a <> '' THEN '[{lexicons.ASSISTANT_LABEL}]: ' || a END) AS content, ts_text, line_start, line_end FROM ex WHERE u <> '' OR a <> '')"""


@query(f"WITH {PAIRS} SELECT session_id, exchange_idx, line_start AS user_line, line_end AS asst_line FROM ex")
def exchange_pairs(spark, sf_dir):
    return S.pair_exchanges(messages(spark, sf_dir)).select("session_id", "exchange_idx", "user_line", "asst_line")


@query(f"WITH {EXCHANGES} SELECT * FROM exch")
def exchange_texts(spark, sf_dir):
    return S.exchanges(messages(spark, sf_dir))


THOUGHT = "na verdade"
BLOCKS = f"""blocks AS (SELECT session_id, line, ts_text, 'b/' || session_id || '/' || line AS id, CASE WHEN length(t) > 3000 THEN {SECTION} ELSE t END AS text
  FROM (SELECT *, {EARLIEST} AS p FROM (SELECT session_id, line, ts_text, '{THOUGHT} ' || text AS t FROM m WHERE role = 'assistant' AND turn % 4 = 1)))"""


@query(f"""WITH RECURSIVE {EXCHANGES}, {BLOCKS}, src AS (SELECT session_id || '/' || exchange_idx AS id, content AS text FROM exch UNION ALL SELECT id, text FROM blocks), {chunk_sql('src')},
  every AS (SELECT session_id, 1 AS pass, exchange_idx AS ord, k, role, piece, ts_text, line_start, line_end FROM pieces JOIN exch ON id = session_id || '/' || exchange_idx
           UNION ALL SELECT session_id, 2, line, k, 'thinking', piece, ts_text, line, line FROM pieces JOIN blocks USING (id))
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pass, ord, k) - 1 AS chunk_index, role, piece AS content, ts_text::TIMESTAMP AS ts, line_start, line_end FROM every""")
def exchange_chunks(spark, sf_dir):
    """Exchanges, then the marked blocks of answers: every fourth message has thought about itself, each has a tool result without a marker."""
    rows = messages(spark, sf_dir)
    block = lambda kind, name, text: F.to_json(F.struct(F.lit(kind).alias("type"), text.alias(name)))
    thought = F.when(F.col("line") % 4 == 2, block("thinking", "thinking", F.concat(F.lit(f"{THOUGHT} "), "text")))
    content = F.concat(F.lit("["), F.concat_ws(",", thought, block("tool_result", "content", F.lit("ok"))), F.lit("]"))
    found = F.when(F.col("type") == "assistant", jsonl.selective_blocks(F.parse_json(content))).otherwise(F.col("blocks"))
    return S.chunks(rows.withColumn("blocks", found)).drop("metadata").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH RECURSIVE src AS (SELECT doc_id AS id, text FROM documents), {chunk_sql('src')} SELECT id AS doc_id, k, piece FROM pieces")
def chunk_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunk_text(F.col("text"))).alias("k", "piece"))


@query(f"WITH {MESSAGES} SELECT row_number() OVER (ORDER BY session_id, line) - 1 AS chunk_id, session_id, line FROM m")
def chunk_numbers(spark, sf_dir):
    return message_chunks(spark, sf_dir).select("chunk_id", "session_id", "line")


# ---------------------------------------------------------------- text index


@query(f"SELECT doc_id AS chunk_id, len({TERMS.format('text')}) AS n_terms, len(list_distinct({TERMS.format('text')})) AS n_distinct FROM documents")
def index_tokens(spark, sf_dir):
    terms = T.index_terms(F.col("content"))
    return documents(spark, sf_dir).select("chunk_id", F.size(terms).alias("n_terms"), F.size(F.array_distinct(terms)).alias("n_distinct"))


@query(f"WITH {LENS} SELECT chunk_id, n FROM lens")
def doc_len(spark, sf_dir):
    return X.document_lengths(documents(spark, sf_dir))


ALL_TOKENS = f"allt AS (SELECT doc_id AS chunk_id, unnest(list_concat(list_concat({TERMS.format('text')}, {TERMS.format('source')}), {TERMS.format('lang')})) AS term FROM documents)"
VOCAB = f"{ALL_TOKENS}, vocab AS (SELECT term, count(DISTINCT chunk_id) AS doc, count(*) AS cnt FROM allt GROUP BY term)"


@query(f"WITH {VOCAB} SELECT term, doc, cnt FROM vocab")
def vocab_doc_counts(spark, sf_dir):
    return X.vocabulary_of(documents(spark, sf_dir))


def bm25_query(name: str, phrases: list[list[str]]) -> None:
    """Register BM25 for phrases, each of one or two terms."""

    def run(spark, sf_dir):
        docs = documents(spark, sf_dir)
        rows = spark.createDataFrame([(0, i, p) for i, p in enumerate(phrases)], "query_id long, phrase_no int, terms array<string>")
        best = X.top_k(X.scan_bm25(docs, rows).withColumn("bm25", F.round("bm25", 6)), 20, F.desc("bm25"), F.col("chunk_id"))
        return best.select("chunk_id", "bm25")

    each = " UNION ALL ".join(
        f"SELECT {i} AS p, chunk_id, count(*) AS f FROM cols WHERE term = '{p[0]}' GROUP BY chunk_id" if len(p) == 1 else f"SELECT {i} AS p, a.chunk_id, count(*) AS f FROM cols a JOIN cols b ON b.chunk_id = a.chunk_id AND b.col = a.col AND b.pos = a.pos + 1 AND b.term = '{p[1]}' WHERE a.term = '{p[0]}' GROUP BY a.chunk_id"
        for i, p in enumerate(phrases)
    )
    cols = " UNION ALL ".join(f"SELECT doc_id AS chunk_id, '{c}' AS col, unnest({TERMS.format(c)}) AS term, generate_subscripts({TERMS.format(c)}, 1) AS pos FROM documents" for c in ("text", "source", "lang"))
    SQL[name] = f"""WITH {LENS}, cols AS ({cols}), f AS ({each}), nt AS (SELECT p, count(*) AS nt FROM f GROUP BY p), s AS (SELECT count(*) AS big, avg(n) AS mean FROM lens),
      w AS (SELECT p, CASE WHEN ln((big - nt + 0.5) / (nt + 0.5)) > 0 THEN ln((big - nt + 0.5) / (nt + 0.5)) ELSE 1e-6 END AS idf FROM nt, s)
      SELECT chunk_id, round(sum(idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * n / mean))), 6) AS bm25 FROM f JOIN w USING (p) JOIN lens USING (chunk_id), s GROUP BY chunk_id ORDER BY bm25 DESC, chunk_id LIMIT 20"""
    QUERIES[name] = run


# Searches for terms, common ones too: their best twenty by blocks in order of impact.
IMPACT_ASKED = {0: ["the"], 1: ["clown"], 2: ["the", "of", "and"], 3: ["clown", "the", "src1"], 4: ["in", "in", "is"], 5: ["none-such"], 6: ["en"]}


def impact_sql() -> str:
    asked = ", ".join(f"({i}, '{t}', {ts.count(t)})" for i, ts in IMPACT_ASKED.items() for t in dict.fromkeys(ts))
    return f"""WITH {LENS}, {ALL_TOKENS}, a(query_id, term, times) AS (VALUES {asked}),
      f AS (SELECT query_id, term, times, chunk_id, count(*) AS f FROM allt JOIN a USING (term) GROUP BY ALL),
      s AS (SELECT count(*) AS big, avg(n) AS mean FROM lens),
      w AS (SELECT query_id, term, greatest(ln((max(big) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM f, s GROUP BY ALL),
      r AS (SELECT query_id, chunk_id, round(sum(times * idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * n / mean))), 12) AS bm25 FROM f JOIN w USING (query_id, term) JOIN lens USING (chunk_id), s GROUP BY ALL)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id)::INT AS pos, chunk_id, bm25 FROM r QUALIFY pos <= 20"""


@query(impact_sql())
def bm25_by_impact(spark, sf_dir):
    docs = documents(spark, sf_dir)
    of_docs = X.terms_by_chunk(docs)
    counts, lengths = X.counts_of_terms(of_docs), of_docs.select("chunk_id", "n")
    blocks = materialize(impact_blocks(counts), "impacts")
    rows = spark.createDataFrame([(i, n, [t]) for i, ts in IMPACT_ASKED.items() for n, t in enumerate(ts)], "query_id long, phrase_no int, terms array<string>")
    found = impact_scores(blocks, X.postings(docs), lengths, vocabulary_of_blocks(blocks), rows, 20, slack=2e-12).withColumn("bm25", F.round("bm25", 12))
    return X.top_k(found, 20, F.desc("bm25"), F.col("chunk_id")).select(F.col("query_id").cast("int").alias("query_id"), "pos", "chunk_id", "bm25")


bm25_query("bm25_single", [["clown"]])
bm25_query("bm25_common", [["the"]])
bm25_query("bm25_or", [["clown"], ["trash"], ["src1"], ["clown"]])
bm25_query("bm25_phrase", [["of", "the"], ["in"]])


@query(f"WITH {MESSAGES}, n AS (SELECT row_number() OVER (ORDER BY session_id, line) - 1 AS chunk_id, session_id, text FROM m) SELECT chunk_id, session_id, 1.0::DOUBLE AS distance, 0.5::DOUBLE AS score FROM n WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') ORDER BY chunk_id LIMIT 30")
def like_fallback(spark, sf_dir):
    return X.like_search(message_chunks(spark, sf_dir), "THE", 30).select("chunk_id", "session_id", "distance", "score")


PREFIXES = ["conv-0000001", "conv-", "conv-00000012", "none such", "conv-00000003-and-a-tail-beyond-any-name"]


@query("SELECT prefix, coalesce((SELECT min(session_id) FROM (SELECT " + SESSION + " AS session_id FROM conversations) WHERE starts_with(session_id, prefix)), prefix) AS session_id FROM (VALUES " + ", ".join(f"('{p}')" for p in PREFIXES) + ") AS v(prefix)")
def prefix_lookup(spark, sf_dir):
    sessions = S.session_metadata(messages(spark, sf_dir))
    return resolve_sessions(sessions, spark.createDataFrame([(p,) for p in PREFIXES], "prefix string"))


# ---------------------------------------------------------------- lexical tolerance


@query("SELECT conv_id, turn, trim(regexp_replace(text, '[-_]', ' ', 'g'), E' \\t\\n\\r') AS text FROM conversations")
def normalize_separators(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_separators(F.col("text")).alias("text"))


def abbreviation_sql() -> str:
    rows = ", ".join(f"('{k}', '{'|'.join(v)}')" for k, v in lexicons.ABBREVIATIONS.items())
    return f"""WITH ab(a, e) AS (VALUES {rows}), w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS x FROM conversations), c AS (SELECT conv_id, turn, trim(x, '.,!?;:') AS token FROM w)
      SELECT token, count(*) AS n, max(e) AS expanded FROM c LEFT JOIN ab ON a = token WHERE length(token) >= 2 GROUP BY token"""


@query(abbreviation_sql())
def abbreviation_expand(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(T.query_tokens(F.lower("text"))).alias("token")).filter(F.length("token") >= 2)
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("expanded", F.array_join(F.element_at(E.abbreviations(), F.col("token")), "|"))


def fuzzy_sql() -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in ASKED)
    masks = "list_transform(range(1, length(term) + 1), lambda i: list_sum(list_transform(range(1, length(token) + 1), lambda j: CASE WHEN substr(token, j::INT, 1) = substr(term, i::INT, 1) THEN 1::HUGEINT << (j - 1)::INT ELSE 0::HUGEINT END))::HUGEINT)"
    full = "((1::HUGEINT << length(token)) - 1)"
    return f"""WITH {VOCAB}, q(query_id, text) AS (VALUES {rows}),
      tok AS (SELECT DISTINCT token FROM (SELECT trim(unnest(string_split(lower(regexp_replace(text, '[-_]', ' ', 'g')), ' ')), '.,!?;:') AS token FROM q) WHERE length(token) >= 4),
      near AS (SELECT token, length(token) AS len, term, doc, {full} AS whole, list_prepend({full}, {masks}) AS steps FROM tok JOIN vocab ON length(term) >= 4 AND 200.0 * least(length(token), length(term)) / (length(token) + length(term)) >= 70),
      r AS (SELECT token, term, doc, 200.0 * (len - bit_count(list_reduce(steps, lambda x, m: ((x + (x & m)) | (x - (x & m))) & whole))) / (len + length(term)) AS ratio FROM near),
      pool AS (SELECT * FROM r WHERE ratio >= 70 QUALIFY row_number() OVER (PARTITION BY token ORDER BY ratio DESC, term) <= 15),
      best AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY ratio DESC, doc DESC, term) AS p FROM pool WHERE term <> token)
      SELECT token, term, round(ratio, 4) AS ratio, doc, p FROM best WHERE p <= 5"""


@query(fuzzy_sql())
def fuzzy_variants(spark, sf_dir):
    tokens = E.tokens(spark.createDataFrame(ASKED, "query_id long, text string"))
    vocab = materialize(X.vocabulary_of(documents(spark, sf_dir)), "vocab")
    return E.fuzzy_variants(tokens.filter(F.length("token") >= 4), vocab).select("token", "term", F.round("ratio", 4).alias("ratio"), "doc", "p")


def classify_sql() -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in ASKED)
    stop = ", ".join(f"'{w}'" for w in lexicons.STOP_WORDS)
    return f"""WITH {VOCAB}, q(query_id, text) AS (VALUES {rows}), w AS (SELECT query_id, trim(unnest(string_split(text, ' ')), '.,!?;:') AS t FROM q),
      d AS (SELECT query_id, bool_or(lower(t) IN ({stop})) AS descriptive FROM w GROUP BY query_id),
      m AS (SELECT query_id, t, (upper(t) = t AND NOT regexp_full_match(t, '[0-9]+') AND length(t) >= 2) OR regexp_matches(t, '^[A-Z]{{2,}}') OR coalesce(doc, 0) <= 10 AS specific
            FROM w LEFT JOIN vocab ON term = lower(t) AND length(term) >= 4 WHERE lower(t) NOT IN ({stop}) AND (length(t) >= 4 OR (upper(t) = t AND regexp_full_match(t, '[A-Za-z]+') AND length(t) >= 2))),
      k AS (SELECT query_id, count(*) AS n, bool_and(specific) AS every FROM m GROUP BY query_id)
      SELECT d.query_id, CASE WHEN NOT descriptive AND coalesce(n, 0) > 0 AND (n <= 2 OR every) THEN 'fts5_dominant' ELSE 'hybrid' END AS mode FROM d LEFT JOIN k USING (query_id)"""


@query(classify_sql())
def classify_query(spark, sf_dir):
    return E.classify(spark.createDataFrame(ASKED, "query_id long, text string"), X.vocabulary_of(documents(spark, sf_dir))).select("query_id", "mode")


# ---------------------------------------------------------------- fusion and ranking


def message_index(spark: SparkSession, sf_dir: str) -> Index:
    chunks = materialize(message_chunks(spark, sf_dir), "chunks")
    p = materialize(X.postings(chunks), "postings")
    of_chunks = X.terms_by_chunk(chunks)
    counts, lengths = X.counts_of_terms(of_chunks), of_chunks.select("chunk_id", "n")
    vocab = materialize(X.vocabulary_of_counts(counts), "vocab")
    return Index(chunks, None, vectors(spark, sf_dir).select("chunk_id", "embedding"), p, lengths, vocab, materialize(impact_blocks(counts), "impacts"), None, materialize(E.gram_index(vocab), "terms"))


MSG_TERMS = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"
HYBRID = f"""WITH {MESSAGES}, n AS (SELECT row_number() OVER (ORDER BY session_id, line) - 1 AS chunk_id, session_id, role, text, {MSG_TERMS} AS t, regexp_extract_all(lower(session_id), '[\\p{{L}}\\p{{N}}]+') AS ts, len(regexp_extract_all(role, '[\\p{{L}}\\p{{N}}]+')) AS nr FROM m),
  lens AS (SELECT chunk_id, len(t) + len(ts) + nr AS len FROM n), s AS (SELECT count(*) AS big, avg(len) AS mean FROM lens),
  v0 AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], {Q0}), vec_id) AS pos, list_distance(embedding::DOUBLE[], {Q0}) AS d FROM embeddings QUALIFY pos <= 60),
  v AS (SELECT v0.chunk_id, 1 / (1 + d) AS score, row_number() OVER (ORDER BY pos) AS pos FROM v0 JOIN n USING (chunk_id) QUALIFY row_number() OVER (ORDER BY pos) <= 20),
  f AS (SELECT chunk_id, len(list_filter(t, lambda x: x = 'thea')) AS f FROM n WHERE list_contains(t, 'thea')),
  k0 AS (SELECT chunk_id, greatest(ln((big - (SELECT count(*) FROM f) + 0.5) / ((SELECT count(*) FROM f) + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) AS r FROM f JOIN lens USING (chunk_id), s),
  k AS (SELECT chunk_id, 1 / (1 + r) AS score, row_number() OVER (ORDER BY r DESC, chunk_id) AS pos FROM k0 QUALIFY pos <= 20),
  b AS (SELECT 0 AS src, * FROM v UNION ALL SELECT 1, * FROM k),
  g AS (SELECT session_id || ':' || substr(text, 1, 100) AS key, arg_max(score, pos) FILTER (src = 0) AS vs, arg_max(chunk_id, pos) FILTER (src = 0) AS vc, sum(score) FILTER (src = 1) AS ks, arg_min(chunk_id, pos) FILTER (src = 1) AS kc, min(src * 1000 + pos) AS first FROM b JOIN n USING (chunk_id) GROUP BY key)
  SELECT coalesce(vc, kc) AS chunk_id, round(coalesce(0.7 * vs, 0) + coalesce(0.3 * ks, 0), 6) AS score, CASE WHEN vs IS NULL THEN 'fts5' WHEN ks IS NULL THEN 'vector' ELSE 'vector+fts5' END AS sources FROM g
  WHERE NOT (ks IS NULL AND 0.7 * vs < 0.42) ORDER BY coalesce(0.7 * vs, 0) + coalesce(0.3 * ks, 0) DESC, first LIMIT 10"""


@query(HYBRID)
def hybrid_fuse(spark, sf_dir):
    index = message_index(spark, sf_dir)
    q = asked(spark, sf_dir, "thea")
    weights = spark.createDataFrame([(0, 0.7, 0.3)], "query_id long, vector_weight double, text_weight double")
    from retrospark.plans.recall import keyword_search, vector_search

    literal = E.tokens(q).select("query_id", "n", "token", F.lit("literal").alias("kind"), F.array().cast("array<string>").alias("expanded"))
    fused = R.fuse(vector_search(index, q, 20), keyword_search(index, q, 20, expanded=literal), weights)
    best = X.top_k(fused, 10, F.desc("score"), F.col("first"), name="place")
    return best.select("chunk_id", F.round("score", 6).alias("score"), F.array_join("sources", "+").alias("sources"))


@query(f"WITH {MESSAGES} SELECT session_id, line, CASE role WHEN 'thinking' THEN 0.6 WHEN 'tool_context' THEN 0.7 ELSE 1.0 END::DOUBLE AS weight FROM m")
def role_weight(spark, sf_dir):
    return messages(spark, sf_dir).select("session_id", "line", R.role_weight(F.col("type")).alias("weight"))


@query(f"SELECT event_id, round(CASE WHEN ts IS NULL OR epoch_us(TIMESTAMP '{AS_OF}') <= epoch_us(ts::TIMESTAMP) THEN 1.0 ELSE pow(2.0, -((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts::TIMESTAMP)) / 86400e6) / 30) END, 6) AS decayed FROM events")
def temporal_decay(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.round(R.decay(F.lit(1.0), ts, F.lit(AS_OF).cast("timestamp"), F.lit(False)), 6).alias("decayed"))


def markers_sql(column: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{m}')" for m in markers) + ")"


@query(f"SELECT doc_id, {markers_sql('text', lexicons.DECISION_MARKERS)} AS architectural FROM documents")
def architectural_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.architectural(F.col("text")).alias("architectural"))


@query(f"SELECT doc_id, {markers_sql('text', lexicons.SELECTIVE_MARKERS)} AS marked FROM documents")
def selective_marker(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.contains_any(F.col("text"), lexicons.SELECTIVE_MARKERS).alias("marked"))


@query(f"SELECT kind, id, {SECTION} AS section FROM (SELECT *, {EARLIEST} AS p FROM (SELECT 'page' AS kind, page_id AS id, html AS t FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents))")
def relevant_section(spark, sf_dir):
    """The part around the earliest marker of each page and document, or its start."""
    of = lambda name, kind, i, t: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col(t).alias("t"))
    rows = of("pages", "page", "page_id", "html").union(of("documents", "document", "doc_id", "text"))
    return rows.select("kind", "id", T.relevant_section(F.col("t"), lexicons.SELECTIVE_MARKERS).alias("section"))


MMR = f"""WITH RECURSIVE q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < {len(ASKED)}),
  {MESSAGES}, n AS (SELECT row_number() OVER (ORDER BY session_id, line) - 1 AS chunk_id FROM m),
  near AS (SELECT query_id, vec_id AS chunk_id, embedding::DOUBLE[] AS v, list_distance(embedding::DOUBLE[], q) AS d FROM q, embeddings QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 30),
  pool AS (SELECT query_id, chunk_id, v, 1 / (1 + d) AS score, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS place FROM near JOIN n USING (chunk_id)),
  likes AS (SELECT a.query_id, a.place, list(list_cosine_similarity(a.v, b.v) ORDER BY b.place) AS sims FROM pool a JOIN pool b USING (query_id) GROUP BY ALL),
  cand AS (SELECT query_id, place, chunk_id, score, sims, CASE WHEN count(*) OVER (PARTITION BY query_id) <= 10 THEN 0 ELSE 0.3 END AS w FROM pool JOIN likes USING (query_id, place)),
  pick AS (
    SELECT query_id, 1 AS rank, place, chunk_id, score, [place] AS chosen FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * score, 9) DESC, place) = 1
    UNION ALL
    SELECT query_id, rank + 1, place, chunk_id, score, list_append(chosen, place) FROM (
      SELECT c.*, k.rank, k.chosen, row_number() OVER (PARTITION BY c.query_id ORDER BY round(0.7 * c.score - c.w * greatest(0, list_max(list_transform(k.chosen, lambda x: c.sims[x]))), 9) DESC, c.place) AS first
      FROM pick k JOIN cand c USING (query_id) WHERE k.rank < 10 AND NOT list_contains(k.chosen, c.place)) WHERE first = 1)
  SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM pick"""


@query(MMR)
def mmr_topk(spark, sf_dir):
    """The thirty nearest messages of each query, of which ten by relevance and difference."""
    index = message_index(spark, sf_dir)
    hits = R.hydrate(knn(index.vectors, asked(spark, sf_dir).filter("q is not null").select("query_id", "q"), 30), index.chunks, 30)
    pool = hits.withColumnRenamed("pos", "place").join(index.vectors.select("chunk_id", F.col("embedding").alias("v")), "chunk_id").withColumn("limit", F.lit(10))
    return R.mmr(pool).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def expansion_sql() -> str:
    """CTEs over messages (n): vocab, and x: query_id, i, token, kind, forms (what it may stand for)."""
    asked = ", ".join(f"({i}, '{t}')" for i, t in ASKED)
    short = ", ".join(f"('{k}', [{', '.join(repr(e) for e in v)}])" for k, v in lexicons.ABBREVIATIONS.items())
    masks = "list_transform(range(1, length(term) + 1), lambda i: list_sum(list_transform(range(1, length(token) + 1), lambda j: CASE WHEN substr(token, j::INT, 1) = substr(term, i::INT, 1) THEN 1::HUGEINT << (j - 1)::INT ELSE 0::HUGEINT END))::HUGEINT)"
    full = "((1::HUGEINT << length(token)) - 1)"
    return f"""{MESSAGES}, n AS (SELECT row_number() OVER (ORDER BY session_id, line) - 1 AS chunk_id, session_id, line, role, text, ts_text::TIMESTAMP AS ts FROM m),
      cols AS (SELECT chunk_id, unnest([{TERMS.format('text')}, {TERMS.format('session_id')}, {TERMS.format('role')}]) AS t FROM n),
      vocab AS (SELECT term, count(DISTINCT chunk_id) AS doc FROM (SELECT chunk_id, unnest(t) AS term FROM cols) GROUP BY term),
      q(query_id, qtext) AS (VALUES {asked}), ab(a, e) AS (VALUES {short}),
      w AS (SELECT query_id, list_filter(list_transform(list_filter(string_split(lower(trim(regexp_replace(qtext, '[-_]', ' ', 'g'))), ' '), lambda x: x <> ''), lambda x: trim(x, '.,!?;:')), lambda x: length(x) >= 2) AS ws FROM q),
      tok AS (SELECT query_id, i, ws[i + 1] AS token FROM (SELECT query_id, ws, unnest(range(0, len(ws))) AS i FROM w)),
      asked AS (SELECT DISTINCT token FROM tok LEFT JOIN ab ON a = token LEFT JOIN vocab ON term = token WHERE a IS NULL AND length(token) >= 4 AND coalesce(doc, 0) <= 10),
      near AS (SELECT token, length(token) AS len, term, doc, {full} AS whole, list_prepend({full}, {masks}) AS steps FROM asked JOIN vocab ON length(term) >= 4 AND 200.0 * least(length(token), length(term)) / (length(token) + length(term)) >= 70),
      r AS (SELECT token, term, doc, 200.0 * (len - bit_count(list_reduce(steps, lambda x, k: ((x + (x & k)) | (x - (x & k))) & whole))) / (len + length(term)) AS ratio FROM near),
      pool AS (SELECT * FROM r WHERE ratio >= 70 QUALIFY row_number() OVER (PARTITION BY token ORDER BY ratio DESC, term) <= 15),
      best AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY ratio DESC, doc DESC, term) AS p FROM pool WHERE term <> token),
      variants AS (SELECT token, list(term ORDER BY p) AS terms FROM best WHERE p <= 5 GROUP BY token),
      x AS (SELECT query_id, i, tok.token, CASE WHEN e IS NOT NULL THEN 'abbreviation' WHEN terms IS NOT NULL THEN 'fuzzy' ELSE 'literal' END AS kind, coalesce(e, terms, []) AS forms FROM tok LEFT JOIN ab ON a = tok.token LEFT JOIN variants v ON v.token = tok.token)"""


def mode_sql() -> str:
    """CTE modes: query_id, mode, over q and vocab."""
    stop = ", ".join(f"'{w}'" for w in lexicons.STOP_WORDS)
    return f"""qw AS (SELECT query_id, trim(unnest(string_split(qtext, ' ')), '.,!?;:') AS t FROM q),
      qd AS (SELECT query_id, bool_or(lower(t) IN ({stop})) AS descriptive FROM qw GROUP BY query_id),
      qm AS (SELECT query_id, (upper(t) = t AND NOT regexp_full_match(t, '[0-9]+') AND length(t) >= 2) OR regexp_matches(t, '^[A-Z]{{2,}}') OR coalesce(doc, 0) <= 10 AS specific
            FROM qw LEFT JOIN vocab ON term = lower(t) AND length(term) >= 4 WHERE lower(t) NOT IN ({stop}) AND (length(t) >= 4 OR (upper(t) = t AND regexp_full_match(t, '[A-Za-z]+') AND length(t) >= 2))),
      qk AS (SELECT query_id, count(*) AS c, bool_and(specific) AS every FROM qm GROUP BY query_id),
      modes AS (SELECT query_id, CASE WHEN NOT descriptive AND coalesce(c, 0) > 0 AND (c <= 2 OR every) THEN 'fts5_dominant' ELSE 'hybrid' END AS mode FROM qd LEFT JOIN qk USING (query_id))"""


def hybrid_sql(k: int) -> str:
    """CTEs up to fused: query_id, chunk_id, score, sources, place (up to k)."""
    return f"""{expansion_sql()}, {mode_sql()},
      lens AS (SELECT chunk_id, sum(len(t)) AS len FROM cols GROUP BY chunk_id), s AS (SELECT count(*) AS big, avg(len) AS mean FROM lens),
      ph AS (SELECT query_id, i, j, {TERMS.format('form')} AS p FROM (SELECT query_id, i, generate_subscripts(list_prepend(token, forms), 1) AS j, unnest(list_prepend(token, forms)) AS form FROM x)),
      hit AS (SELECT query_id, i, j, chunk_id, sum(len(list_filter(range(1, len(t) - len(p) + 2), lambda b: t[b:b + len(p) - 1] = p))) AS f FROM ph, cols WHERE len(p) > 0 AND list_has_all(t, p) GROUP BY ALL HAVING f > 0),
      wt AS (SELECT query_id, i, j, greatest(ln((max(big) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM hit, s GROUP BY ALL),
      bm AS (SELECT query_id, chunk_id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) AS r FROM hit JOIN wt USING (query_id, i, j) JOIN lens USING (chunk_id), s GROUP BY ALL),
      kw AS (SELECT query_id, chunk_id, 1 / (1 + r) AS score, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, chunk_id) AS pos FROM bm QUALIFY pos <= {2 * k}),
      qv AS (SELECT query_id, embedding::DOUBLE[] AS qe FROM q JOIN embeddings ON vec_id = query_id),
      v0 AS (SELECT query_id, vec_id AS chunk_id, list_distance(embedding::DOUBLE[], qe) AS d FROM qv, embeddings QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= {6 * k}),
      ve AS (SELECT query_id, chunk_id, 1 / (1 + d) AS score, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS pos FROM v0 JOIN n USING (chunk_id) QUALIFY pos <= {2 * k}),
      b AS (SELECT 0 AS src, * FROM ve UNION ALL SELECT 1, * FROM kw),
      g AS (SELECT query_id, session_id || ':' || substr(text, 1, 100) AS key, arg_max(score, pos) FILTER (src = 0) AS vs, arg_max(chunk_id, pos) FILTER (src = 0) AS vc, sum(score) FILTER (src = 1) AS ks, arg_min(chunk_id, pos) FILTER (src = 1) AS kc, min(src * 1000 + pos) AS first FROM b JOIN n USING (chunk_id) GROUP BY ALL),
      sc AS (SELECT query_id, coalesce(vc, kc) AS chunk_id, CASE mode WHEN 'hybrid' THEN 0.7 ELSE 0.25 END AS wv, CASE mode WHEN 'hybrid' THEN 0.3 ELSE 0.75 END AS wk, vs, ks, first FROM g JOIN modes USING (query_id)),
      fused AS (SELECT query_id, chunk_id, coalesce(wv::DOUBLE * vs, 0) + coalesce(wk::DOUBLE * ks, 0) AS score, CASE WHEN vs IS NULL THEN 'fts5' WHEN ks IS NULL THEN 'vector' ELSE 'vector+fts5' END AS sources,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS place FROM sc WHERE NOT (ks IS NULL AND wv::DOUBLE * vs < 0.42) QUALIFY place <= {k})"""


def recall_sql(limit: int) -> str:
    """CTEs up to picked: query_id, rank, chunk_id, score, sources, of a search with role weight, decay and diversity."""
    words = "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda z: z <> ''))"
    marked = markers_sql("text", lexicons.DECISION_MARKERS)
    age = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400e6)"
    return f"""{hybrid_sql(3 * limit)},
      aged AS (SELECT query_id, chunk_id, place, sources, session_id, text, embedding::DOUBLE[] AS v, {words} AS words,
        score * CASE WHEN {marked} OR ts IS NULL OR {age} <= 0 THEN 1.0 ELSE pow(2.0, -{age} / 30) END AS score FROM fused JOIN n USING (chunk_id) LEFT JOIN embeddings ON vec_id = chunk_id),
      sims AS (SELECT a.query_id, a.place, list(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN list_cosine_similarity(a.v, b.v) WHEN len(a.words) > 0 AND len(b.words) > 0 THEN len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) ELSE 0.0 END ORDER BY b.place) AS sims,
        list(b.place ORDER BY b.place) AS places FROM aged a JOIN aged b USING (query_id) GROUP BY ALL),
      cand AS (SELECT query_id, place, chunk_id, score, sims, places, CASE WHEN count(*) OVER (PARTITION BY query_id) <= {limit} THEN NULL ELSE 1 END AS many FROM aged JOIN sims USING (query_id, place)),
      pick AS (
        SELECT query_id, 1 AS rank, place, chunk_id, score, [place] AS chosen FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN many IS NULL THEN score ELSE round(0.7 * score, 9) END DESC, place) = 1
        UNION ALL
        SELECT query_id, rank + 1, place, chunk_id, score, list_append(chosen, place) FROM (
          SELECT c.*, k.rank, k.chosen, row_number() OVER (PARTITION BY c.query_id ORDER BY CASE WHEN many IS NULL THEN c.score ELSE round(0.7 * c.score - 0.3 * greatest(0, list_max(list_transform(k.chosen, lambda z: c.sims[list_position(c.places, z)]))), 9) END DESC, c.place) AS nth
          FROM pick k JOIN cand c USING (query_id) WHERE k.rank < {limit} AND NOT list_contains(k.chosen, c.place)) WHERE nth = 1)"""


@query(f"WITH RECURSIVE {recall_sql(5)} SELECT query_id, pick.rank::INT AS rank, chunk_id, session_id, round(pick.score, 6) AS score, sources FROM pick JOIN aged USING (query_id, chunk_id)")
def recall_full(spark, sf_dir):
    found = recall(message_index(spark, sf_dir), asked(spark, sf_dir), 5, as_of=F.lit(AS_OF).cast("timestamp"))
    return found.select("query_id", "rank", "chunk_id", "session_id", F.round("score", 6).alias("score"), F.array_join("sources", "+").alias("sources"))


@query(f"WITH {hybrid_sql(10)} SELECT query_id, place::INT AS place, chunk_id, round(score, 6) AS score FROM fused")
def hybrid_batch(spark, sf_dir):
    return hybrid_search(message_index(spark, sf_dir), asked(spark, sf_dir), 10).select("query_id", "place", "chunk_id", F.round("score", 6).alias("score"))


QUOTED = "list_transform(forms, lambda f: '\"' || f || '\"')"


@query(f"""WITH {expansion_sql()}, {mode_sql()}, e AS (SELECT query_id, '[' || string_agg('{{"original":"' || token || '","expanded":[' || array_to_string({QUOTED}, ',') || '],"type":"' || kind || '"}}', ',' ORDER BY i) || ']' AS expansions FROM x WHERE kind <> 'literal' GROUP BY query_id)
  SELECT query_id, trim(regexp_replace(qtext, '[-_]', ' ', 'g')) AS normalized_query, mode AS search_mode, expansions FROM q JOIN modes USING (query_id) LEFT JOIN e USING (query_id)""")
def query_infos(spark, sf_dir):
    index = message_index(spark, sf_dir)
    return query_info(asked(spark, sf_dir), index.vocab).select("query_id", "normalized_query", "search_mode", F.to_json("expansions").alias("expansions"))


@query()
def result_json(spark, sf_dir):
    return admin.result_json(recall(message_index(spark, sf_dir), asked(spark, sf_dir), 3, as_of=F.lit(AS_OF).cast("timestamp")))


# ---------------------------------------------------------------- rendering, listings, sources


@query("SELECT conv_id, turn, regexp_replace(text, '(the|and)', '**`\\1`**', 'gi') AS text FROM conversations")
def highlight_markdown(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.highlight(F.col("text"), ["the", "and"]).alias("text"))


@query("SELECT page_id, sha256('m:64:' || url) AS hash FROM pages")
def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.text_hash(F.col("url"), "m", 64).alias("hash"))


@query("SELECT page_id, trim(substr(regexp_replace(regexp_replace(lower(url), '[^\\w\\s-]', '', 'g'), '\\s+', '-', 'g'), 1, 40), '-') AS slug FROM pages")
def url_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, CASE WHEN len(p) >= 2 THEN p[-2] || '/' || p[-1] WHEN length(d) > 0 THEN substr(d, 1, 30) ELSE 'unknown' END AS label FROM (SELECT page_id, d, list_filter(string_split(d, '-'), lambda x: x <> '' AND x <> 'Users') AS p FROM (SELECT page_id, replace(replace(url, '/', '-'), ':', '') AS d FROM pages))")
def project_label(spark, sf_dir):
    d = F.replace(F.replace("url", F.lit("/"), F.lit("-")), F.lit(":"), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", T.project_label(d).alias("label"))


@query(f"SELECT event_id, CASE WHEN d > 30 THEN 'ha ' || (d // 30) || 'm' WHEN d > 0 THEN 'ha ' || d || 'd' WHEN h > 0 THEN 'ha ' || h || 'h' ELSE 'agora' END AS age FROM (SELECT event_id, s // 86400 AS d, (s % 86400) // 3600 AS h FROM (SELECT event_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts::TIMESTAMP)) // 1000000 AS s FROM events))")
def age_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.age_label(F.col("ts").cast("timestamp"), F.lit(AS_OF).cast("timestamp")).alias("age"))


@query("SELECT vec_id, repeat('▓', greatest(0, least(10, trunc(10 * embedding[1]::DOUBLE)::INT))::INT) || repeat('░', (10 - greatest(0, least(10, trunc(10 * embedding[1]::DOUBLE)::INT)))::INT) AS bar FROM embeddings")
def score_bars(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", T.score_bar(F.element_at("embedding", 1).cast("double")).alias("bar"))


STATUS = "WITH f AS (SELECT page_id, url || '#' || page_id AS p, sha256(html) AS h, strlen(html) AS n FROM pages), k AS (SELECT p, CASE WHEN page_id % 3 = 0 THEN 'old' ELSE h END AS kh, CASE WHEN page_id % 2 = 0 THEN n + 1 ELSE n - 1 END AS kn FROM f WHERE page_id % 5 <> 0) SELECT page_id, CASE WHEN k.p IS NULL THEN 'new' WHEN h = kh THEN 'unchanged' WHEN n > kn THEN 'changed' ELSE 'changed_nonmonotonic' END AS status FROM f LEFT JOIN k USING (p)"


@query(STATUS)
def index_status(spark, sf_dir):
    """Two states of a set of files: the one known lacks some, and has other hashes and sizes for others."""
    pages = table(spark, sf_dir, "pages")
    files = pages.select("page_id", F.concat_ws("#", "url", "page_id").alias("file_path"), F.sha2("html", 256).alias("file_hash"), F.octet_length("html").alias("file_size"))
    known = files.filter("page_id % 5 <> 0").select("file_path", F.when(F.col("page_id") % 3 == 0, "old").otherwise(F.col("file_hash")).alias("file_hash"), F.when(F.col("page_id") % 2 == 0, F.col("file_size") + 1).otherwise(F.col("file_size") - 1).alias("file_size"))
    return jsonl.with_status(files, known).select("page_id", "status")


@query(f"WITH {MESSAGES}, e AS (SELECT session_id, min(ts_text) FILTER (role = 'system') AS s FROM m GROUP BY session_id) SELECT session_id, s::TIMESTAMP AS started_at, row_number() OVER (ORDER BY s DESC NULLS LAST, session_id) AS place FROM e")
def session_list(spark, sf_dir):
    meta = S.session_metadata(messages(spark, sf_dir)).select("session_id", T.parse_timestamp(F.col("started_ts_text")).alias("started_at"))
    ordered = admin.sessions(meta).withColumn("place", F.row_number().over(X.Window.orderBy(F.desc_nulls_last("started_at"), "session_id")))
    return ordered.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query("SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM conversations) AS chunks, least((SELECT count(*) FROM conversations), (SELECT count(*) FROM embeddings)) AS embedded, (SELECT count(*) FROM conversations) - least((SELECT count(*) FROM conversations), (SELECT count(*) FROM embeddings)) AS missing")
def index_counts(spark, sf_dir):
    chunks = message_chunks(spark, sf_dir)
    return admin.status(chunks.select("session_id").distinct(), chunks, vectors(spark, sf_dir)).drop("missing_percent")


EXPORT = f"""WITH {MESSAGES}, h AS (SELECT session_id, min(ts_text) FILTER (role = 'system') AS s, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM m GROUP BY session_id),
  p AS (SELECT session_id, line, CASE role WHEN 'user' THEN '### Usuário *' WHEN 'assistant' THEN '### Claude *' ELSE '### ' || role || ' *' END || strftime(ts_text::TIMESTAMP, '%Y-%m-%d %H:%M:%S') || '*' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) AS part FROM m),
  b AS (SELECT session_id, string_agg(part, chr(10) ORDER BY line) AS body FROM p GROUP BY session_id)
  SELECT session_id, substr(session_id, 1, 8) || '.md' AS file_name, sha256('# Sessão ' || substr(session_id, 1, 8) || chr(10) || chr(10) || '**Projeto:** p  ' || chr(10) || '**Início:** ' || coalesce(strftime(s::TIMESTAMP, '%Y-%m-%d %H:%M:%S'), '') || '  ' || chr(10) || '**Session ID:** `' || session_id || '`  ' || chr(10) || '**Mensagens:** ' || u || ' user + ' || a || ' assistant  ' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || body) AS markdown FROM h JOIN b USING (session_id)"""


@query(EXPORT)
def export_markdown(spark, sf_dir):
    msgs = messages(spark, sf_dir)
    meta = S.session_metadata(msgs).select("session_id", "title", F.lit("p").alias("project_label"), T.parse_timestamp(F.col("started_ts_text")).alias("started_at"), "user_messages", "asst_messages")
    chunks = msgs.select("session_id", F.col("line").alias("chunk_index"), F.col("type").alias("role"), F.col("text").alias("content"), T.parse_timestamp(F.col("ts_text")).alias("ts"))
    return admin.session_markdown(meta, chunks).withColumn("markdown", F.sha2("markdown", 256))


@query("SELECT count(DISTINCT text) AS embedded, (SELECT count(*) FROM conversations) AS chunks FROM conversations")
def embedding_cache(spark, sf_dir):
    """How many texts are embedded for all chunks: each text once."""
    chunks = message_chunks(spark, sf_dir)
    found, fresh = embed_with_cache(chunks, None, HashingProvider(64))
    return fresh.agg(F.count(F.lit(1)).alias("embedded")).join(found.agg(F.count(F.lit(1)).alias("chunks")), F.lit(True))
