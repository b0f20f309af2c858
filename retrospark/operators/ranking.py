"""Fusion, role weight, decay and diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrospark import lexicons
from retrospark.config import Settings
from retrospark.functions import text as T
from retrospark.operators.text_index import top_k
from retrospark.storage import look_up, settle

PAYLOAD = ["chunk_id", "session_id", "role", "content", "ts", "distance"]


def hydrate(hits: DataFrame, chunks: DataFrame, k: Column | int, session: str | None = None) -> DataFrame:
    """Hits with their chunk; those of the session asked for, and of them the first k. The filter comes after the
    engines' own top-k, so that a small session may get nothing. Few hits are computed first, and look their chunks up."""
    cols = [c for c in ("chunk_id", "session_id", "role", "content", "ts") if c in chunks.columns]
    hits = settle(hits, "hits", costly=True)
    rows = hits.join(look_up(chunks, hits, "chunk_id").select(*cols), "chunk_id")
    if session is not None:
        rows = rows.filter(F.col("session_id") == session)
    return top_k(rows, k, F.col("pos"), name="pos")


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, weights: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, score, sources, payload columns, first (place of insertion).

    Hits meet by session and the first hundred characters. Of vector hits that meet, the last gives score and payload;
    keyword hits that meet add up, and the first gives the payload if no vector hit does. Vector-only hits below the
    floor go.
    """
    tag = lambda df, src: df.withColumns({"src": F.lit(src), "key": F.concat_ws(":", "session_id", F.substr("content", F.lit(1), F.lit(100)))})
    both = tag(vector_hits, 0).unionByName(tag(keyword_hits, 1), allowMissingColumns=True)
    payload = F.struct(*[c for c in PAYLOAD if c in both.columns])
    vec, key = F.col("src") == 0, F.col("src") == 1
    by = both.groupBy("query_id", "key").agg(
        F.max_by("score", F.when(vec, F.col("pos"))).alias("v"), F.max_by(payload, F.when(vec, F.col("pos"))).alias("vp"), F.sum(F.when(key, F.col("score"))).alias("k"), F.min_by(payload, F.when(key, F.col("pos"))).alias("kp"),
        F.min(F.struct("src", "pos")).alias("first"),
    )
    rows = by.join(weights.select("query_id", "vector_weight", "text_weight"), "query_id")
    score = F.coalesce(F.col("vector_weight") * F.col("v"), F.lit(0.0)) + F.coalesce(F.col("text_weight") * F.col("k"), F.lit(0.0))
    sources = F.filter(F.array(F.when(F.col("v").isNotNull(), "vector"), F.when(F.col("k").isNotNull(), "fts5")), lambda s: s.isNotNull())
    rows = rows.select("query_id", score.alias("score"), sources.alias("sources"), F.coalesce("vp", "kp").alias("p"), "first")
    kept = rows.filter(~((F.col("sources") == F.array(F.lit("vector"))) & (F.col("score") < settings.min_score)))
    return kept.select("query_id", "score", "sources", "p.*", "first")


def role_weight(role: Column) -> Column:
    table = F.create_map(*[x for k, v in lexicons.ROLE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, role), F.lit(1.0))


def architectural(content: Column, whole_words: bool = False) -> Column:
    return (T.contains_any_word if whole_words else T.contains_any)(content, lexicons.DECISION_MARKERS)


def decay(score: Column, ts: Column, as_of: Column, timeless: Column, half_life_days: float = 30.0) -> Column:
    """score * 2^(-age / half-life); unchanged for timeless texts, without a time, and for times to come."""
    age = (F.unix_micros(as_of) - F.unix_micros(ts)) / 86_400e6
    return F.when(timeless | ts.isNull() | (age <= 0), score).otherwise(score * F.pow(F.lit(2.0), -age / half_life_days))


def mmr(candidates: DataFrame, k_col: str = "limit", weight: float = 0.7) -> DataFrame:
    """query_id, rank and the candidates' columns: relevance against likeness to what is chosen already; values that agree
    in nine digits are ties, which the fused order breaks.

    candidates: query_id, place (fused order), score, content, v (vector or null), limit; a few for each query. Queries are
    packed by hash, so one task works through many of them.
    """
    spark = candidates.sparkSession
    names = [c for c in candidates.columns if c not in ("v", k_col)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = candidates.repartition(parts, "query_id").sortWithinPartitions("query_id", "place")

    def choose(g: pd.DataFrame) -> list[int]:
        limit, n = int(g[k_col].iloc[0]), len(g)
        score = g.score.to_numpy(float)
        if n <= limit:
            return list(np.argsort(-score, kind="stable"))
        words = [set(c.lower().split()) for c in g.content]
        vecs = [None if v is None else np.asarray(v, float) for v in g.v]
        most, out, left = np.zeros(n), [], list(range(n))
        for _ in range(limit):
            best = max(left, key=lambda i: (round(weight * score[i] - (1 - weight) * most[i], 9), -i))
            out.append(best)
            left.remove(best)
            for i in left:
                a, b = vecs[best], vecs[i]
                if a is not None and b is not None:
                    norm = np.linalg.norm(a) * np.linalg.norm(b)
                    like = float(a @ b / norm) if norm > 0 and len(a) == len(b) else 0.0
                else:
                    like = len(words[best] & words[i]) / len(words[best] | words[i]) if words[best] and words[i] else 0.0
                most[i] = max(most[i], like)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(frame: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, g in frame.groupby("query_id", sort=False):
                picked = g.iloc[choose(g)][names].copy()
                picked["rank"] = np.arange(1, len(picked) + 1, dtype=np.int32)
                out.append(picked)
            return pd.concat(out)

        for b in batches:
            if not len(b):
                continue
            last = b.query_id.iloc[-1]
            held.append(b[b.query_id != last])
            ready = pd.concat(held)
            if len(ready):
                yield done(ready) if (ready.query_id != last).all() else done(ready[ready.query_id != last])
            rest = ready[ready.query_id == last]
            held = [rest, b[b.query_id == last]]
        if held and len(final := pd.concat(held)):
            yield done(final)

    fields = {f.name: f for f in candidates.schema.fields}
    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([fields[n] for n in names] + [StructField("rank", IntegerType())])
    return packed.mapInPandas(run, schema)
