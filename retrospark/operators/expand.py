"""From a query's text to phrases: separators, abbreviations, fuzzy variants, and the query's mode.

queries: query_id, text. All queries are worked on together; the vocabulary is a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrospark import lexicons
from retrospark.config import Settings
from retrospark.functions import text as T
from retrospark.operators.text_index import few_terms
from retrospark.storage import rows_of, settle


def abbreviations():
    """The table as a map expression."""
    items = [x for k, v in lexicons.ABBREVIATIONS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))]
    return F.create_map(*items)


def tokens(queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, n (place), token, expanded (null, or what an abbreviation stands for)."""
    words = T.query_tokens(F.lower(T.normalize_separators(F.col("text"))))
    each = queries.select("query_id", F.posexplode(F.filter(words, lambda w: F.length(w) >= 2)).alias("n", "token"))
    return each.withColumn("expanded", F.element_at(abbreviations(), F.col("token")))


def gram_index(vocab: DataFrame) -> DataFrame:
    """gram, size, term: a row for each distinct gram of each term, in order of grams, so that files can be passed over."""
    return vocab.select(F.explode(F.array_distinct(T.grams(F.col("term")))).alias("gram"), F.length("term").alias("size"), "term").repartitionByRange("gram", "size").sortWithinPartitions("gram", "size")


def known_terms(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """term, doc of the vocabulary that are among words (column token): one read, of the rows that are named."""
    words = settle(words.select(F.array("token").alias("terms")).distinct(), "words")
    named = few_terms(words)
    rows = vocab.join(words.select(F.explode("terms").alias("term")), "term", "left_semi") if named is None else vocab.filter(F.col("term").isin(named))
    return settle(rows.select("term", "doc"), "known")


def near_terms(tokens: DataFrame, terms: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """token, term, ratio of all pairs whose ratio reaches the threshold. terms: as gram_index() gives them.

    Terms meet tokens by the grams that they share, and are compared where these are as many as the threshold asks for. Up to
    a threshold of two thirds, terms may be near without any; then they meet by length.
    """
    cut = settings.fuzzy_threshold * 100
    n = F.length("token")
    least, most = F.ceil(n * cut / (200 - cut)), F.floor(n * (200 - cut) / cut)
    few = settle(tokens.select("token").distinct(), "doubtful")
    asked = few.withColumn("masks", F.when(n <= T.PLACES, T.letter_masks(F.col("token"))))
    fits = (F.col("size") >= settings.fuzzy_min_length) & F.col("size").between(least, most)
    if 3 * cut > 200:
        each = asked.select("token", F.posexplode(T.grams(F.col("token"))).alias("i", "gram"))
        there = rows_of(few)
        named = None if there is None else sorted({g for r in there for g in T.grams_of(r.token)})
        rows = terms if named is None else terms.filter(F.col("gram").isin(named))
        met = rows.join(each, "gram").filter(fits).groupBy("token", "term", "size").agg(F.count_distinct("i").alias("shared"))
        met = met.filter(F.col("shared") >= T.shared_grams(n, F.col("size"), cut)).join(asked, "token")
    else:
        sizes = asked.withColumn("size", F.explode(F.sequence(least.cast("int"), most.cast("int"))))
        met = terms.select("term", "size").distinct().join(sizes, "size").filter(fits)
    return met.withColumn("ratio", T.indel_ratio(F.col("token"), F.col("term"), F.col("masks"))).filter(F.col("ratio") >= cut).select("token", "term", "ratio")


def fuzzy_variants(tokens: DataFrame, vocab: DataFrame, settings: Settings = Settings(), terms: DataFrame | None = None) -> DataFrame:
    """token, term, ratio, doc: for each token its likeliest terms.

    Of the 3 * fuzzy_max_expansions terms with the best ratio (ties by term), other than the token itself, the first
    by ratio, then by documents. terms: the vocabulary's gram index, which may have terms that the vocabulary hasn't.
    """
    near = settle(near_terms(tokens, gram_index(vocab) if terms is None else terms, settings), "near", costly=True)
    there = near.join(known_terms(vocab, near.select(F.col("term").alias("token"))), "term")
    pool = there.withColumn("p", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("ratio"), "term"))).filter(F.col("p") <= 3 * settings.fuzzy_max_expansions)
    ranked = pool.filter("term <> token").withColumn("p", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("ratio"), F.desc("doc"), "term")))
    return ranked.filter(F.col("p") <= settings.fuzzy_max_expansions).select("token", "term", "ratio", "doc", "p")


def asked_words(queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """token: the words whose documents expand() and classify() want to know."""
    lower = lambda text: F.transform(T.query_tokens(text), lambda w: F.lower(w))
    words = F.array_union(lower(F.lower(T.normalize_separators(F.col("text")))), lower(F.col("text")))
    return queries.select(F.explode(words).alias("token")).filter(F.length("token") >= settings.fuzzy_min_length)


def expand(queries: DataFrame, vocab: DataFrame, settings: Settings = Settings(), terms: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """query_id, n, token, kind (abbreviation, fuzzy, literal), expanded (array). known: known_terms() of asked_words()."""
    each = tokens(queries, settings)
    known = known_terms(vocab, asked_words(queries, settings)) if known is None else known
    each = each.join(known.select(F.col("term").alias("token"), F.col("doc").alias("known")), "token", "left")
    doubtful = F.col("expanded").isNull() & (F.length("token") >= settings.fuzzy_min_length) & (F.coalesce("known", F.lit(0)) <= settings.rare_docs)
    variants = fuzzy_variants(each.filter(doubtful), vocab, settings, terms).groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "term"))), lambda s: s["term"]).alias("variants"))
    each = each.join(variants, "token", "left")
    fuzzy = doubtful & F.col("variants").isNotNull()
    kind = F.when(F.col("expanded").isNotNull(), "abbreviation").when(fuzzy, "fuzzy").otherwise("literal")
    return each.select("query_id", "n", "token", kind.alias("kind"), F.coalesce("expanded", F.when(fuzzy, F.col("variants")), F.array().cast("array<string>")).alias("expanded"))


def phrases(expanded: DataFrame) -> DataFrame:
    """query_id, phrase_no, terms: each token and each thing that it may stand for is a phrase."""
    forms = expanded.select("query_id", "n", F.posexplode(F.concat(F.array("token"), F.col("expanded"))).alias("m", "form"))
    return forms.select("query_id", (F.col("n") * 100 + F.col("m")).alias("phrase_no"), T.index_terms(F.col("form")).alias("terms"))


def invalid(expanded: DataFrame) -> DataFrame:
    """query_id of queries whose match expression can't be read, as a token has a quotation mark inside."""
    return expanded.filter(F.contains("token", F.lit('"'))).select("query_id").distinct()


def sanitized(text: Column) -> Column:
    """Phrases of a normalised query none of whose words has two characters or more; null if nothing can be matched."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    long = F.filter(words, lambda w: F.length(w) > 2)
    several = F.when(F.size(long) > 0, long)
    return F.when(text.rlike(r"""[(){}\[\]^*:!"']"""), F.array(text)).when(F.size(words) > 1, several).when(text != "", F.array(text))


def bare_phrases(queries: DataFrame, expanded: DataFrame) -> DataFrame:
    """query_id, needle, phrases (array, or null where only a look-up is left) of queries without a token."""
    bare = queries.join(expanded.select("query_id").distinct(), "query_id", "left_anti")
    needle = T.strip(T.normalize_separators(F.col("text")))
    return bare.select("query_id", needle.alias("needle"), sanitized(needle).alias("phrases"))


def classify(queries: DataFrame, vocab: DataFrame, settings: Settings = Settings(), known: DataFrame | None = None) -> DataFrame:
    """query_id, mode (hybrid, fts5_dominant), vector_weight, text_weight, by the query as it was written. known: as for expand()."""
    stop = F.array(*[F.lit(w) for w in lexicons.STOP_WORDS])
    words = queries.select("query_id", T.query_tokens(F.col("text")).alias("words"))
    descriptive = F.exists("words", lambda w: F.array_contains(stop, F.lower(w)))
    capital = lambda w: (F.upper(w) == w) & w.rlike(r"^\p{L}+$") & (F.length(w) >= 2)
    meaning = F.filter("words", lambda w: ~F.array_contains(stop, F.lower(w)) & ((F.length(w) >= settings.fuzzy_min_length) | capital(w)))
    words = words.select("query_id", descriptive.alias("descriptive"), meaning.alias("meaning"))
    each = words.select("query_id", F.explode("meaning").alias("w")).withColumn("token", F.lower("w"))
    known = known_terms(vocab, asked_words(queries, settings)) if known is None else known
    known = known.select(F.col("term").alias("token"), "doc")
    loud = (F.upper("w") == F.col("w")) & ~F.col("w").rlike(r"^\p{Nd}+$") & (F.length("w") >= 2)
    plain = each.join(known, "token", "left").filter(~(loud | F.col("w").rlike("^[A-Z]{2,}") | (F.coalesce("doc", F.lit(0)) <= settings.rare_docs))).groupBy("query_id").agg(F.count(F.lit(1)).alias("plain"))
    n = F.size("meaning")
    specific = ~F.col("descriptive") & (n > 0) & ((n <= 2) | F.col("plain").isNull())
    pick = lambda a, b: F.when(specific, F.lit(a)).otherwise(F.lit(b))
    return words.join(plain, "query_id", "left").select("query_id", pick("fts5_dominant", "hybrid").alias("mode"), pick(settings.specific_vector_weight, settings.vector_weight).alias("vector_weight"), pick(settings.specific_text_weight, settings.text_weight).alias("text_weight"))
