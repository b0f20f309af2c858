"""Impact-ordered postings: the best chunks by BM25 without scoring all that hold a term.

The postings of a term are sorted by what each adds to a score, and cut into blocks of BLOCK chunks. A block's row has
the arrays, and numbers that bound all of it. A term adds weight / (1 + a / count + b * length / count / mean length), so
the largest count `top` and the least ratio `least` of length to count give a bound for whatever the corpus's mean length is
when a query comes; `best`, the largest fraction at the mean length `at` of the time of writing, gives one that is exact
then, and grows with the mean length at most in proportion. Blocks need not be written anew when the corpus grows.

A search takes the blocks with the largest bounds first, which gives k chunks a score that they reach at least; the k-th of
these is a floor. A chunk of a block can reach it only if the block's bound, with the largest of what the query's other terms
can add, does; other blocks are left out. Whatever reaches the floor has all its postings in blocks that stay, so its score
is exact, and the first k are those of a scan.

A term that most chunks hold is dealt to many tasks: blocks are cut from ranges of (term, impact).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrospark.operators.text_index import K1, B, few_terms, idf, phrase_counts, top_k
from retrospark.storage import materialize, rows_of, settle

BLOCK = 128
BLOCKS = "term string, best double, at double, top double, least double, c int, ids array<long>, counts array<int>, lengths array<int>"


def counts_by_chunk(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """term, chunk_id, f (occurrences), n (the chunk's length)."""
    return postings.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).cast("int").alias("f")).join(lengths.select("chunk_id", F.col("n").cast("int").alias("n")), "chunk_id")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (term, chunk_id, f, n, impact, at) in order of terms and impacts. A block doesn't cross a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        codes = b.column(0).dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
        cuts = np.flatnonzero(place % BLOCK == 0)
        f, n = b.column(2).to_numpy(), b.column(3).to_numpy()
        offsets = pa.array(np.append(cuts, len(codes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, b.column(i)) for i in (1, 2, 3)]
        columns = [*(b.column(i).take(pa.array(cuts)) for i in (0, 4, 5)), pa.array(np.maximum.reduceat(f, cuts).astype(float)), pa.array(np.minimum.reduceat(n / f, cuts)), pa.array(np.diff(np.append(cuts, len(codes))).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns + lists, names=["term", "best", "at", "top", "least", "c", "ids", "counts", "lengths"])


def _added(weight: Column, per_count: Column, ratio: Column, mean: Column) -> Column:
    """What a term adds where 1 / count is per_count and length / count is ratio."""
    return weight / (1 + K1 * (1 - B) * per_count + K1 * B * ratio / mean)


def impact_blocks(counts: DataFrame) -> DataFrame:
    """Blocks of the rows (term, chunk_id, f, n), in order of terms, best first. counts is read more than once."""
    mean = float(counts.agg(F.avg("n")).first()[0] or 1.0)
    impact = _added(F.lit(1.0), 1 / F.col("f"), F.col("n") / F.col("f"), F.lit(mean))
    order = ("term", F.desc("impact"), "chunk_id")
    rows = counts.select("term", "chunk_id", "f", "n", impact.alias("impact")).repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.withColumn("at", F.lit(mean)).mapInArrow(_cut, BLOCKS)


def unpacked(blocks: DataFrame, *columns: str) -> DataFrame:
    """columns, chunk_id, f, n: a row for each posting."""
    each = F.arrays_zip("ids", "counts", "lengths")
    return blocks.select(*columns, F.explode(each).alias("p")).select(*columns, F.col("p.ids").alias("chunk_id"), F.col("p.counts").alias("f"), F.col("p.lengths").alias("n"))


def best_blocks(blocks: DataFrame, vocab: DataFrame, stats: DataFrame, terms: DataFrame, others: DataFrame, k: int, slack: float, dead: DataFrame | None) -> DataFrame:
    """query_id, weight, mean and the blocks that can hold one of a query's first k chunks.

    terms: query_id, term, times; others: query_id, chunk_id, part, of a query's other phrases; stats: n_docs, mean.
    """
    asked = terms.join(vocab.select("term", "doc"), "term").join(F.broadcast(stats), F.lit(True))
    asked = settle(asked.select("query_id", "term", "mean", (idf(F.col("n_docs"), F.col("doc")) * F.col("times") * (K1 + 1)).alias("weight")), "asked")
    few = rows_of(asked)
    named = few_terms(asked.select(F.array("term").alias("terms"))) if few is None else sorted({r.term for r in few})
    mine = (blocks if named is None else blocks.filter(F.col("term").isin(named))).join(asked, "term")
    # A little above the exact value, so that rounding loses nothing.
    now = F.col("weight") * F.col("best") * F.greatest(F.lit(1.0), F.col("mean") / F.col("at"))
    bound = F.least(_added(F.col("weight"), 1 / F.col("top"), F.col("least"), F.col("mean")), now)
    mine = mine.withColumn("bound", bound * (1 + 1e-9))
    first = top_k(mine.withColumn("key", F.struct("query_id", "term")), 1 + 2 * k // BLOCK, F.desc("bound"), F.element_at("ids", 1), by="key", name="no")
    seeds = parts_of(first).unionByName(others.select("query_id", "chunk_id", "part"))
    best = top_k(alive(seeds, dead).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("s")), k, F.desc("s"), F.col("chunk_id"))
    floor = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("s")).otherwise(0.0).alias("floor"))
    most = mine.groupBy("query_id", "term").agg(F.max("bound").alias("most"))
    rest = others.groupBy("query_id", "phrase_no").agg(F.max("part").alias("most"))
    every = most.select("query_id", "most").unionByName(rest.select("query_id", "most")).groupBy("query_id").agg(F.sum("most").alias("every"))
    need = most.join(every, "query_id").join(floor, "query_id", "left").select("query_id", "term", ((F.coalesce("floor", F.lit(0.0)) - slack) * (1 - 1e-9) - (F.col("every") - F.col("most"))).alias("need"))
    return mine.join(settle(need, "need", costly=True), ["query_id", "term"]).filter(F.col("bound") >= F.col("need"))


def vocabulary_of_blocks(blocks: DataFrame) -> DataFrame:
    """As vocabulary, from blocks of chunks that are all there: a row for each 128 postings of a term."""
    cnt = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return blocks.groupBy("term").agg(F.sum(F.col("c").cast("long")).alias("doc"), F.sum(cnt).alias("cnt"))


def parts_of(blocks: DataFrame) -> DataFrame:
    """query_id, chunk_id, part: what each posting of the blocks adds."""
    p = unpacked(blocks, "query_id", "weight", "mean")
    return p.select("query_id", "chunk_id", _added(F.col("weight"), 1 / F.col("f"), F.col("n") / F.col("f"), F.col("mean")).alias("part"))


def alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    return rows if dead is None else rows.join(dead.select("chunk_id"), "chunk_id", "left_anti")


def impact_scores(blocks: DataFrame, postings: DataFrame, lengths: DataFrame, vocab: DataFrame, phrases: DataFrame, k: int, slack: float = 0.0, dead: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, bm25: for each query its first k chunks at least, and all within `slack` of the k-th, with the scores
    that bm25() gives; others that are there may have too low a score.

    phrases: query_id, phrase_no, terms; repeated phrases add up. Phrases of several terms are counted by place in the
    postings, as ever. blocks may hold chunks that are gone, named in dead; the other tables hold what is alive.
    """
    n = F.size("terms")
    terms = phrases.filter(n == 1).groupBy("query_id", F.element_at("terms", 1).alias("term")).agg(F.count(F.lit(1)).alias("times"))
    several = settle(phrases.filter(n > 1), "several")
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean"))
    others = several.select("query_id", "phrase_no", F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("part")).limit(0)
    if rows_of(several) != []:
        named = few_terms(several)
        f = phrase_counts(postings if named is None else postings.filter(F.col("term").isin(named)), several)
        with_it = f.groupBy("query_id", "phrase_no").agg(F.count(F.lit(1)).alias("with_it"))
        scored = f.join(with_it, ["query_id", "phrase_no"]).join(lengths, "chunk_id").join(F.broadcast(stats), F.lit(True))
        part = _added(idf(F.col("n_docs"), F.col("with_it")) * (K1 + 1), 1 / F.col("f"), F.col("n") / F.col("f"), F.col("mean"))
        others = materialize(scored.select("query_id", "phrase_no", "chunk_id", part.alias("part")), "phrases")
    found = parts_of(best_blocks(blocks, vocab, stats, terms, others, k, slack, dead))
    return alive(found.unionByName(others.select("query_id", "chunk_id", "part")), dead).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("bm25"))
