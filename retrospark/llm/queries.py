"""The queries op1_ to op13_ and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrospark.llm import bpe, codes, exact_dedup, mixing, near_dedup, neighbours, phrases, pii, quality, substrings, toxicity, warc
from retrospark.storage import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(warc.write_warc(_table(spark, sf_dir, "pages")), "warc")
    return warc.read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, kinds = pii.BASE_KINDS, (*pii.BASE_KINDS, *pii.ADDED_KINDS)
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    n_spans = sum((F.size(k) for k in kinds[1:]), F.size(kinds[0])).cast("long")
    return found.select("doc_id", *counts, F.sha2(pii.span_text(*base), 256).alias("base_sha256"), pii.span_text(*kinds).alias("spans"), n_spans.alias("n_spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(phrases.collocations(_table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(_table(spark, sf_dir, "embeddings"))
    digest = books.sha256() if books else codes.hashlib.sha256(b"").hexdigest()
    out = codes.with_label_errors(coded)
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_dedup, op2_token_counts, op3_mix_sources, op4_neighbours, op5_warc, op6_substrings, op7_pii, op8_toxicity, op9_exact_dedup, op10_sentencepiece, op11_quality, op12_phrases, op13_vector_codes)}


#: op1: all shingles of all documents, pairs of documents that share one, and what is reached over links.
NEAR_DEDUP_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM reached JOIN ways ON a = node),
    component AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id, doc_id = root AS kept
    FROM documents LEFT JOIN n USING (doc_id) JOIN component ON node = doc_id"""

#: op5: digests in base 32, five hexadecimal digits of SHA-1 to four of base 32.
WARC_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY t) AS first,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

#: op6: all windows of 50 bytes, in hexadecimal; those that a smaller document has; and the runs that they cover.
SUBSTRINGS_SQL = """
    WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    windows AS (SELECT doc_id, i, substr(h, (2 * i + 1)::INT, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM t)),
    least AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
    hits AS (SELECT doc_id, i FROM windows JOIN least USING (w) WHERE first < doc_id),
    steps AS (SELECT doc_id, i, i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS new FROM hits),
    numbered AS (SELECT doc_id, i, count(*) FILTER (coalesce(new, true)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
    runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY ALL),
    gaps AS (SELECT doc_id, run, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS f, a, b FROM runs),
    kept AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail,
                string_agg(substr(h, (2 * f + 1)::INT, (2 * (a - f))::INT), '' ORDER BY run) AS head FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(tail, 0) + 1)::INT))) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"""

EXACT_DEDUP_SQL = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


#: op12: all phrases of one to four words, and what is contained in what.
PHRASES_SQL = r"""
    WITH t AS (SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) AS piece FROM t)),
    g AS (SELECT lang, k, ws[i:i + k - 1] AS p FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k))),
    f AS (SELECT lang, k, p, count(*) AS f FROM g GROUP BY ALL),
    total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    candidates AS (SELECT lang, k, p, f AS a FROM f WHERE k >= 2 AND f >= 30),
    cuts AS (SELECT lang, k, p, a, unnest(range(1, k)) AS c FROM candidates),
    scored AS (SELECT c.lang, c.k, c.p, c.a, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[:c.c] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.c + 1:]
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, c.c) = 1),
    inside AS (SELECT DISTINCT l.lang, l.p[i:i + m - 1] AS p, l.a FROM (SELECT lang, p, k, a, m, unnest(range(1, k - m + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < k) l),
    most AS (SELECT lang, p, max(a) AS b FROM inside GROUP BY ALL)
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, array_to_string(s.p, ' ')) AS rank, array_to_string(s.p, ' ') AS phrase, s.a, l, r, n, score
    FROM scored s JOIN total USING (lang) LEFT JOIN most m ON m.lang = s.lang AND m.p = s.p WHERE b IS NULL OR 100::HUGEINT * b < 80::HUGEINT * s.a QUALIFY rank <= 2000"""

#: op13: parts as rows (part, place, component); two rounds, then the last assignment.
_ROUND = """
    a{r} AS (SELECT vec_id, p, e, d FROM (SELECT c.vec_id, c.p, b.e, sum((c.c - b.c) * (c.c - b.c)) AS d FROM c JOIN b{r} b ON b.p = c.p AND b.i = c.i GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""
_BOOK = """
    m{r} AS (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM a{r} JOIN c USING (vec_id, p) GROUP BY ALL),
    b{n} AS (SELECT p, e, i, coalesce((s - ((s % n) + n) % n) // n, b.c) AS c FROM b{r} b LEFT JOIN m{r} USING (p, e, i))"""
VECTOR_CODES_SQL = f"""
    WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS s FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c AS (SELECT vec_id, j // s AS p, j % s AS i, v[j + 1] AS c FROM (SELECT vec_id, v, s, unnest(range(0, len(v))) AS j FROM k)),
    seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64),
    b0 AS (SELECT p, e, i, c FROM seeds JOIN c USING (vec_id)),{_ROUND.format(r=0)},{_BOOK.format(r=0, n=1)},{_ROUND.format(r=1)},{_BOOK.format(r=1, n=2)},{_ROUND.format(r=2)},
    coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM b2) AS codebooks_sha256 FROM coded JOIN k USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": NEAR_DEDUP_SQL, "op5_warc": WARC_SQL, "op6_substrings": SUBSTRINGS_SQL, "op9_exact_dedup": EXACT_DEDUP_SQL, "op12_phrases": PHRASES_SQL, "op13_vector_codes": VECTOR_CODES_SQL}
