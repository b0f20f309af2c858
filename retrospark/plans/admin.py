"""Listings, health, exports and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrospark.functions import text as T
from retrospark.sources.markdown import write_folder


def sessions(sessions: DataFrame, project: str | None = None) -> DataFrame:
    """Latest first; of projects whose label holds a text, in any case."""
    rows = sessions if project is None else sessions.filter(F.contains(F.lower("project_label"), F.lit(project.lower())))
    return rows.orderBy(F.desc_nulls_last("started_at"), "session_id")


def status(sessions: DataFrame, chunks: DataFrame, vectors: DataFrame, cache: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """One row: how many there are of each, how many chunks lack a vector, and the last run."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    with_vector = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_semi")
    out = one(sessions, "sessions").join(one(chunks, "chunks"), F.lit(True)).join(one(with_vector, "embedded"), F.lit(True))
    out = out.withColumn("missing", F.col("chunks") - F.col("embedded")).withColumn("missing_percent", F.when(F.col("chunks") > 0, F.round(100 * F.col("missing") / F.col("chunks"), 1)).otherwise(0.0))
    if cache is not None:
        out = out.join(one(cache, "cached"), F.lit(True))
    if runs is not None:
        out = out.join(runs.agg(F.max_by(F.struct("run_id", "started_at", "files_scanned", "files_indexed", "chunks_created", "errors"), "run_id").alias("last_run")), F.lit(True))
    return out


def doctor(sessions: DataFrame | None, chunks: DataFrame | None, vectors: DataFrame | None, dimensions: int | None, files: DataFrame | None) -> DataFrame:
    """check, ok, detail; the last row is the whole."""
    spark = next(df.sparkSession for df in (sessions, chunks, vectors, files) if df is not None)
    rows = [("database", chunks is not None and sessions is not None, "tables are there" if chunks is not None else "no index")]
    if chunks is not None and vectors is not None:
        n, have = chunks.count(), chunks.join(vectors.select("chunk_id"), "chunk_id", "left_semi").count()
        rows.append(("embeddings", have == n, f"{have} of {n} chunks have a vector"))
        size = vectors.select(F.size("embedding").alias("n")).first()
        rows.append(("dimensions", size is None or dimensions in (None, size.n), f"{size.n if size else 'no'} components, {dimensions} set"))
    if files is not None:
        n = files.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_subagent").alias("s")).first()
        rows.append(("session logs", n.n > 0, f"{n.n} files, {n.s} of subagents"))
    rows.append(("all", all(r[1] for r in rows), ""))
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


def session_markdown(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """session_id, file_name, markdown: each session with its chunks in order."""
    ts = F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    head = F.when(F.col("role") == "user", F.concat(F.lit("### Usuário *"), ts, F.lit("*\n"))).when(F.col("role") == "assistant", F.concat(F.lit("### Claude *"), ts, F.lit("*\n"))).when(F.col("role") == "exchange", F.concat(F.lit("*"), ts, F.lit("*\n"))).otherwise(F.concat(F.lit("### "), F.col("role"), F.lit(" *"), ts, F.lit("*\n")))
    part = F.concat(head, F.lit("\n"), F.col("content"), F.lit("\n\n---\n"))
    body = chunks.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("part")))), lambda s: s["part"]), "\n").alias("body"))
    top = F.concat(
        F.lit("# "), F.col("title"), F.lit("\n\n**Projeto:** "), F.col("project_label"), F.lit("  \n**Início:** "), F.coalesce(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")), F.lit("  \n**Session ID:** `"), F.col("session_id"),
        F.lit("`  \n**Mensagens:** "), F.col("user_messages"), F.lit(" user + "), F.col("asst_messages"), F.lit(" assistant  \n\n---\n\n"),
    )
    return sessions.join(body, "session_id", "left").select("session_id", F.concat(F.substr("session_id", F.lit(1), F.lit(8)), F.lit(".md")).alias("file_name"), F.concat(top, F.coalesce("body", F.lit(""))).alias("markdown"))


def export_all(sessions: DataFrame, chunks: DataFrame, folder: str) -> None:
    """Every session's Markdown as a file of a new folder, all or none: named by the first eight characters of its
    identifier, by the whole of it where others begin so too."""
    files = session_markdown(sessions, chunks)
    shared = files.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("n") > 1, F.concat("session_id", F.lit(".md"))).otherwise(F.col("file_name"))
    write_folder(files.join(shared, "file_name").select(name.alias("file_name"), F.col("markdown").alias("text")), folder)


def result_json(results: DataFrame) -> DataFrame:
    """query_id, json: the results of each query in order."""
    has = lambda c: F.col(c) if c in results.columns else F.lit(None).cast("string")
    item = F.struct("rank", "content", "session_id", has("title").alias("session_title"), has("project_label").alias("project"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), "score", "role", "sources")
    return results.groupBy("query_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(item)), lambda s: s.dropFields("rank")).alias("results")), {"ignoreNullFields": "false"}).alias("json"))


def result_markdown(rows: list, query: str, n_sessions: int, n_chunks: int, expansions: list | None = None) -> str:
    """The results of one query (collected rows, in order) as Markdown for a reader."""
    if not rows:
        return f'Nenhum resultado encontrado para: "{query}"\n({n_sessions} sessões indexadas, {n_chunks} chunks no banco)'
    out = [f'## Resultados para: "{query}"', f"*{len(rows)} resultados de {n_sessions} sessões indexadas*\n"]
    expansions = expansions or []
    if expansions:
        told = [f"{'fuzzy' if e['type'] == 'fuzzy' else 'abrev'}: {e['original']} → {', '.join(e['expanded'][:3])}" for e in expansions]
        out.append(f"*Expansões: {'; '.join(told)}*\n")
    terms = T.highlight_terms(query, [x for e in expansions for x in e["expanded"]])
    for i, r in enumerate(rows, 1):
        r = r.asDict() if hasattr(r, "asDict") else r
        ts = r["ts"].strftime("%d/%m/%Y %H:%M") if r.get("ts") else "?"
        sources = " + ".join(s.upper() for s in r["sources"]) if r.get("sources") else "?"
        out += [f"### {i}. {r.get('project_label') or ''} — {r.get('title') or ''}", f"*Sessão `{r['session_id'][:8]}` | {ts} | score: {r['score']:.3f} | {sources}*", f"\n{mark(r['content'], terms)}\n", "---\n"]
    return "\n".join(out)


def mark(text: str, terms: list[str], before: str = "**`", after: str = "`**") -> str:
    """T.highlight for one text."""
    import re

    real = [re.escape(t) for t in terms if t]
    return re.sub("|".join(real), lambda m: before + m[0] + after, text, flags=re.I) if real and text else text


def terminal(results: DataFrame, as_of: Column) -> DataFrame:
    """query_id, rank, line, preview: bar, score, age and sources of each result, and its first 300 characters."""
    line = F.concat_ws("  ", T.score_bar(F.col("score")), F.format_number("score", 3), T.age_label(F.col("ts"), as_of), F.array_join("sources", "+"))
    return results.select("query_id", "rank", line.alias("line"), F.concat(F.substr("content", F.lit(1), F.lit(300)), F.when(F.length("content") > 300, "...").otherwise("")).alias("preview"))
