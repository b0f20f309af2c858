"""Commands: init, status, index, search, doctor, sessions, export."""

from __future__ import annotations

import argparse
import datetime
import json
import os
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from retrospark.config import Settings
from retrospark.embeddings import embed, provider
from retrospark.plans import admin
from retrospark.plans.indexer import Store, backfill, update
from retrospark.plans.recall import query_info, recall, resolve_session
from retrospark.sources import jsonl


def clip_path(folder: str, query: str, name: str, today: datetime.date) -> str:
    """Where a clip goes: a name of its own, or one made of the date and the query."""
    if name != "-auto-":
        return name if os.path.isabs(name) else os.path.join(folder, name)
    slug = re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", query.lower()))[:40].strip("-")
    return os.path.join(folder, f"{today:%Y-%m-%d}_{slug}.md")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="retrospark")
    p.add_argument("--data", default=os.environ.get("RETROSPARK_DATA", os.path.expanduser("~/.retrospark/index")))
    p.add_argument("--logs", default=os.environ.get("RETROSPARK_SESSIONS", os.path.expanduser("~/sessions")))
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "status", "doctor", "backfill"):
        sub.add_parser(name)
    i = sub.add_parser("index")
    i.add_argument("--full", action="store_true")
    i.add_argument("--subagents", action=argparse.BooleanOptionalAction, default=False)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-n", "--limit", type=int, default=5)
    s.add_argument("-s", "--session")
    s.add_argument("-f", "--format", choices=("rich", "context", "json"), default="rich")
    s.add_argument("-o", "--output", nargs="?", const="-auto-")
    o = sub.add_parser("sessions")
    o.add_argument("-p", "--project")
    e = sub.add_parser("export")
    e.add_argument("session", nargs="?")
    return p


def settings_provider(settings: Settings):
    """The provider that the settings name."""
    if settings.provider == "local":
        return provider("local", settings.dimensions, model=settings.model, base_url=settings.base_url, instruction=settings.instruction)
    if settings.provider == "api":
        return provider("api", key=os.environ.get("RETROSPARK_API_KEY", ""), model=settings.model, base_url=settings.base_url, dimensions=settings.dimensions)
    return provider(settings.provider, settings.dimensions)


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    store, settings = Store(spark, args.data), Settings.from_environment()
    embedder = settings_provider(settings)
    if args.command == "init":
        store.make_folder()
        return f"index in {args.data}"
    if args.command == "index":
        r = update(store, args.logs, args.full, args.subagents, embedder, settings)
        return f"{r.scanned} files, {r.indexed} indexed, {r.skipped} unchanged, {r.chunks} chunks"
    if args.command == "backfill":
        if embedder is None:
            return "no provider is set: RETROSPARK_PROVIDER names one"
        backfill(store, embedder)
        return "all chunks have a vector"
    if args.command == "doctor":
        rows = admin.doctor(store.read("sessions"), store.read("chunks"), store.read("vectors"), settings.dimensions, jsonl.listing(spark, args.logs, True)).collect()
        return "\n".join(f"{'ok ' if r.ok else 'BAD'} {r.check} {r.detail}" for r in rows)
    index = store.index()
    if args.command == "status":
        return "\n".join(f"{k}: {v}" for k, v in admin.status(index.sessions, index.chunks, index.vectors, store.read("cache"), store.read("runs")).first().asDict(True).items())
    if args.command == "sessions":
        return "\n".join(f"{r.session_id[:8]} {r.started_at or '':} {r.project_label} {r.title} ({r.user_messages}+{r.asst_messages})" for r in admin.sessions(index.sessions, args.project).toLocalIterator())
    if args.command == "export" and args.session is None:
        folder = f"{args.data.rstrip('/')}/export-{datetime.datetime.now():%Y%m%d-%H%M%S}"
        admin.export_all(index.sessions, index.chunks, folder)
        return folder
    if args.command == "export":
        whole = resolve_session(index.sessions, args.session)
        row = admin.session_markdown(index.sessions.filter(F.col("session_id") == whole), index.chunks.filter(F.col("session_id") == whole)).first()
        if row is None:
            return "no such session"
        path = f"{args.data.rstrip('/')}/{row.file_name}"
        store.put(path, row.markdown)
        return path
    asked = spark.createDataFrame([(0, args.query)], "query_id long, text string")
    asked = embed(asked, embedder, "text", "query", "q") if embedder else asked.withColumn("q", F.lit(None).cast("array<float>"))
    session = resolve_session(index.sessions, args.session) if args.session else None
    found = recall(index, asked, args.limit, session, settings=settings)
    info = query_info(asked, index.vocab, settings, index.terms).first().asDict(True)
    rows = sorted(found.collect(), key=lambda r: r["rank"])
    text = admin.result_markdown(rows, args.query, index.sessions.count(), index.chunks.count(), info["expansions"])
    if args.output:
        store.put(clip_path(f"{args.data.rstrip('/')}/clips", args.query, args.output, datetime.date.today()), f"# Clipping — {args.query}\n\n---\n\n{text}")
    if args.format == "json":
        out = [{"content": r.content, "session_id": r.session_id, "session_title": r.title, "project": r.project_label, "timestamp": r.ts.isoformat() if r.ts else None, "score": r.score, "role": r.role, "sources": r.sources} for r in rows]
        return json.dumps({"results": out, "query_info": info}, ensure_ascii=False, indent=2)
    if args.format == "context":
        return text
    lines = admin.terminal(spark.createDataFrame(rows, found.schema), F.current_timestamp()).orderBy("rank").collect() if rows else []
    return "\n".join(f"{r.rank}. {r.line}\n   {r.preview}" for r in lines) or text


def main() -> None:
    spark = SparkSession.builder.appName("retrospark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(run(spark, parser().parse_args()), file=sys.stdout)


if __name__ == "__main__":
    main()
