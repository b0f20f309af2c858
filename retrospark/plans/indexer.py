"""The index: tables in a folder, brought up to date from session logs.

An update writes a segment, a folder with the rows that are new, and then a version, a small file that names all segments;
versions are numbered, and one appears by a rename, so readers see the one before or the one after. Segments are never
changed: chunks that are gone are named in a table of their own, and what a term's counts lose is written as a
negative number. Versions but the last two go, and segments that only they name.

Segments are merged by size: those of one class (chunks up to FANOUT, up to its square, and so on; a segment counts as large
as the largest after it) become one when FANOUT of them are neighbours. So a chunk is written again when it gets to a larger
class only, as often as the logarithm of the index's size at most, and there are fewer than FANOUT segments of each class.

Of a session whose file has changed, chunks with the same number, role and text stay as they are, with their vectors;
so a session that has grown costs what it has grown by.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrospark.config import Settings
from retrospark.embeddings import Provider, embed_with_cache
from retrospark.functions import text as T
from retrospark.operators import sessions as S
from retrospark.operators.expand import gram_index
from retrospark.operators.impact import alive as still_there
from retrospark.operators.impact import impact_blocks, unpacked
from retrospark.operators.text_index import counts_of_terms, postings, terms_by_chunk, vocabulary, vocabulary_of_counts
from retrospark.plans.recall import Index
from retrospark.sources import jsonl
from retrospark.storage import materialize

#: Tables of rows that belong to a chunk, and segments of one class that are merged.
OF_CHUNKS, FANOUT = ("chunks", "vectors", "postings", "lengths"), 4
#: Tables in ranges of chunk numbers, so that a look-up passes over files.
IN_RANGES = ("chunks", "vectors", "lengths")


@dataclass
class Report:
    scanned: int = 0
    indexed: int = 0
    chunks: int = 0
    errors: list[str] = field(default_factory=list)

    @property
    def skipped(self) -> int:
        return self.scanned - self.indexed


@dataclass
class Version:
    """What a version's file says: its segments, oldest first, each with its tables and chunks; and the next free chunk number."""

    number: int = -1
    segments: list[list] = field(default_factory=list)
    next_chunk: int = 0

    def paths(self, table: str) -> list[str]:
        return [f"{name}/{table}" for name, tables, *_ in self.segments if table in tables]

    def sizes(self) -> list[int | None]:
        """Chunks of each segment, None where the file doesn't say."""
        return [size[0] if size else None for _, _, *size in self.segments]


class Store:
    """The tables of an index in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def make_folder(self) -> None:
        self._fs.mkdirs(self._path(self.root))

    def put(self, path: str, text: str) -> None:
        """Write a text file, in whatever file system its path names."""
        at = self._path(path)
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted(int(x.getPath().getName()) for x in found if x.getPath().getName().isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version by its number, or the last."""
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return Version()
            number = numbers[-1]
        said = json.loads(self.spark.read.text(f"{self.root}/versions/{number:08d}", wholetext=True).first().value)
        return Version(number, said["segments"], said["next_chunk"])

    def read(self, table: str, version: Version | None = None) -> DataFrame | None:
        """The rows of a table that are alive."""
        v = self.version() if version is None else version
        rows = self._rows(table, v)
        if rows is None:
            return None
        if table in OF_CHUNKS and (dead := self._rows("dead_chunks", v)) is not None:
            rows = rows.join(dead, "chunk_id", "left_anti")
        if table == "sessions":
            rows = self._alive_sessions(rows, v).drop("segment")
        if table == "vocab" and len(v.paths("vocab")) > 1:
            rows = rows.groupBy("term").agg(F.sum("doc").alias("doc"), F.sum("cnt").alias("cnt")).filter("doc > 0")
        return rows

    def _alive_sessions(self, rows: DataFrame, v: Version) -> DataFrame:
        if (dead := self._rows("dead_sessions", v)) is None:
            return rows
        upto = dead.groupBy("session_id").agg(F.max("before").alias("before"))
        return rows.join(upto, (rows.session_id == upto.session_id) & (F.col("segment") < F.col("before")), "left_anti")

    def _rows(self, table: str, v: Version) -> DataFrame | None:
        paths = [f"{self.root}/{p}" for p in v.paths(table)]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, tables: dict[str, DataFrame], before: Version, next_chunk: int | None = None, instead: slice | None = None) -> Version:
        """Write a segment after those of `before`, or instead of some of them, then the version that names it."""
        number, name = (self._numbers() or [-1])[-1] + 1, f"segment-{uuid.uuid4().hex}"
        for table, df in tables.items():
            rows = df.withColumn("segment", F.lit(number).cast("long")) if table == "sessions" and "segment" not in df.columns else df
            if table in IN_RANGES:
                rows = rows.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
            rows.write.parquet(f"{self.root}/{name}/{table}")
        size = self.spark.read.parquet(f"{self.root}/{name}/chunks").count() if "chunks" in tables else 0
        segments = list(before.segments)
        segments[instead or slice(len(segments), None)] = [[name, sorted(tables), size]]
        v = Version(number, segments, before.next_chunk if next_chunk is None else next_chunk)
        draft = self._path(f"{self.root}/versions/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"segments": v.segments, "next_chunk": v.next_chunk}).encode()))
        out.close()
        if not self._fs.rename(draft, self._path(f"{self.root}/versions/{number:08d}")):
            raise RuntimeError(f"version {number} was written by someone else meanwhile")
        self._forget()
        return v

    def _forget(self) -> None:
        """Delete what only versions before the last two name."""
        numbers = self._numbers()
        needed = {name for n in numbers[-2:] for name, *_ in self.version(n).segments}
        for n in numbers[:-2]:
            for name, *_ in self.version(n).segments:
                if name not in needed:
                    self._fs.delete(self._path(f"{self.root}/{name}"), True)
            self._fs.delete(self._path(f"{self.root}/versions/{n:08d}"), False)

    def index(self) -> Index:
        v = self.version()
        if not v.paths("chunks"):
            raise ValueError("the index is empty")
        vectors = self.read("vectors", v)
        if vectors is None:
            vectors = self.spark.createDataFrame([], "chunk_id long, embedding array<float>")
        # Segments of before there were blocks by impact make a search score all postings.
        whole = all("impacts" in tables for _, tables, *_ in v.segments if "postings" in tables)
        return Index(self.read("chunks", v), self.read("sessions", v), vectors, self.read("postings", v), self.read("lengths", v), self.read("vocab", v), self.read("impacts", v) if whole else None, self._rows("dead_chunks", v), self._rows("terms", v) if all("terms" in tables for _, tables, *_ in v.segments if "chunks" in tables) else None)


def session_rows(files: DataFrame, messages: DataFrame) -> DataFrame:
    """The session table of files. Files that give one identifier count as that of the first path."""
    of_file = messages.groupBy("file_path").agg(F.min("session_id").alias("session_id"))
    facts = files.select("file_path", "file_hash", "file_size", "project_dir", "is_subagent", "parent_session_id")
    one = facts.join(of_file, "file_path").groupBy("session_id").agg(F.min_by(F.struct(*facts.columns), "file_path").alias("f")).select("session_id", "f.*")
    meta = S.session_metadata(messages)
    return one.join(meta, "session_id").select(
        "session_id", F.col("project_dir").alias("project_path"), T.project_label(F.col("project_dir")).alias("project_label"), "title", T.parse_timestamp(F.col("started_ts_text")).alias("started_at"), T.parse_timestamp(F.col("ended_ts_text")).alias("ended_at"),
        "user_messages", "asst_messages", "file_path", "file_hash", "file_size", "is_subagent", "parent_session_id", F.current_timestamp().alias("indexed_at"),
    )


def indexed(chunks: DataFrame) -> dict[str, DataFrame]:
    """The text index of chunks: postings in order of terms, so that files can be passed over by term, the same by impact,
    lengths and vocabulary."""
    p = materialize(postings(chunks), "postings")
    of_chunks = terms_by_chunk(chunks)
    counts, lengths = counts_of_terms(of_chunks), of_chunks.select("chunk_id", "n")
    return {"postings": p.repartitionByRange("term").sortWithinPartitions("term", "chunk_id"), "impacts": impact_blocks(counts), "lengths": lengths} | vocabulary_tables(vocabulary_of_counts(counts))


def without(store: Store, v: Version, gone: DataFrame) -> DataFrame:
    """What the vocabulary loses with the chunks of gone: negative counts."""
    lost = vocabulary(store.read("postings", v).join(gone, "chunk_id", "left_semi"))
    return lost.select("term", (-F.col("doc")).alias("doc"), (-F.col("cnt")).alias("cnt"))


def last_chunk_index(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """session_id, last: the number of each session's last chunk, -1 for sessions without one."""
    last = chunks.groupBy("session_id").agg(F.max("chunk_index").alias("last"))
    return sessions.select("session_id").join(last, "session_id", "left").select("session_id", F.coalesce("last", F.lit(-1)).alias("last"))


def update(store: Store, root: str, full: bool = False, include_subagents: bool = False, provider: Provider | None = None, settings: Settings = Settings()) -> Report:
    """Bring the index up to date with the logs under root; full starts anew. A file that can't be read is reported and left out."""
    spark = store.spark
    began = spark.sql("select current_timestamp() t").first().t
    v = Version() if full else store.version()
    old = store.read("sessions", v)
    files = materialize(jsonl.with_status(jsonl.scan(spark, root, include_subagents), old), "files")
    lines = jsonl.read(spark, root, jsonl.changed(files))
    lines = materialize(lines, "parsed")
    bad = materialize(jsonl.unreadable(lines), "bad")
    told = files.filter("status = 'unreadable'").select("file_path", F.lit("can't be read").alias("why")).union(bad.select("file_path", F.lit("not UTF-8")))
    errors = [f"{r.file_path.rsplit('/', 1)[-1]}: {r.why}" for r in told.orderBy("file_path").toLocalIterator()]
    new = jsonl.changed(files).join(bad, "file_path", "left_anti")
    report = Report(files.count(), new.count(), 0, errors)
    if not report.indexed and old is not None:
        store.write(_log(store, v, began, report), v)
        merge(store)
        return report
    messages = materialize(jsonl.messages(lines.join(bad, "file_path", "left_anti")), "messages")
    rows = materialize(session_rows(new, messages), "sessions")
    chunks = S.chunks(messages, settings)
    tables = {"sessions": rows}
    if old is not None:
        # Sessions of the changed files, by their identifiers before and now.
        touched = rows.select("session_id").union(old.join(rows.select("file_path"), "file_path", "left_semi").select("session_id")).distinct()
        touched = materialize(touched, "touched")
        known = store.read("chunks", v).join(touched, "session_id", "left_semi")
        same = ["session_id", "chunk_index", "role", "content"]
        kept = chunks.join(known.select(*same, F.col("chunk_id").alias("kept")), same, "left")
        kept = materialize(kept, "compared")
        chunks = kept.filter("kept is null").drop("kept")
        dead = materialize(known.select("chunk_id").join(kept.select(F.col("kept").alias("chunk_id")), "chunk_id", "left_anti"), "dead")
        tables["dead_sessions"] = touched.withColumn("before", F.lit((store._numbers() or [-1])[-1] + 1).cast("long"))
        if not dead.isEmpty():
            tables["dead_chunks"] = dead
    chunks = S.with_chunk_ids(chunks).withColumn("chunk_id", F.col("chunk_id") + v.next_chunk)
    chunks = materialize(chunks, "chunks")
    report.chunks = chunks.count()
    tables |= {"chunks": chunks} | indexed(chunks)
    if "dead_chunks" in tables:
        tables["vocab"] = tables["vocab"].unionByName(without(store, v, tables["dead_chunks"])).repartitionByRange("term").sortWithinPartitions("term")
    if provider is not None:
        tables["vectors"], tables["cache"] = embed_with_cache(chunks, store.read("cache", v), provider)
    v = store.write(tables | _log(store, v, began, report), v, v.next_chunk + report.chunks)
    merge(store)
    return report


def vocabulary_tables(vocab: DataFrame) -> dict[str, DataFrame]:
    """The vocabulary and its gram index, both in an order that lets a search pass over files."""
    vocab = materialize(vocab, "vocab")
    return {"vocab": vocab.repartitionByRange("term").sortWithinPartitions("term"), "terms": gram_index(vocab)}


def impact_rows(blocks: DataFrame, dead: DataFrame | None) -> DataFrame:
    """The postings of blocks whose chunks are alive."""
    return still_there(unpacked(blocks, "term"), dead)


def due(sizes: list[int | None], fanout: int | None = None) -> slice | None:
    """Of segments with so many chunks, oldest first, the neighbours to be merged next; None if there are none. Segments of
    unknown size are larger than all."""
    fanout = FANOUT if fanout is None else fanout
    classes, largest = [], 0
    for n in reversed(sizes):
        size_class = 1 << 30 if n is None else next(c for c in range(1 << 30) if n <= fanout**c)
        largest = max(largest, size_class)
        classes.insert(0, largest)
    end = len(classes)
    while end:  # from the smallest class
        start = end - 1
        while start and classes[start - 1] == classes[end - 1]:
            start -= 1
        if end - start >= fanout and classes[start] < 1 << 30:
            return slice(start, end)
        end = start
    return None


def merge(store: Store) -> None:
    """Merge segments until there are fewer than FANOUT of each class."""
    while (part := due((v := store.version()).sizes())) is not None:
        merge_segments(store, v, part)


def merge_segments(store: Store, v: Version, part: slice) -> Version:
    """Write what is alive of some neighbouring segments as one in their place."""
    own, oldest = Version(v.number, v.segments[part], v.next_chunk), part.start == 0
    rows, dead = {t: store._rows(t, own) for t in sorted({t for _, tables, *_ in own.segments for t in tables})}, store._rows("dead_chunks", v)
    out = {t: df for t, df in rows.items() if t not in ("dead_chunks", "dead_sessions", "terms")}
    for t in out.keys() & set(OF_CHUNKS):
        out[t] = still_there(out[t], dead)
    if "postings" in out:
        out["postings"] = out["postings"].repartitionByRange("term").sortWithinPartitions("term", "chunk_id")
    if "impacts" in out:
        out["impacts"] = impact_blocks(materialize(impact_rows(rows["impacts"], dead), "counts"))
    if "sessions" in out:
        out["sessions"] = store._alive_sessions(out["sessions"], v)
    if "vocab" in out:
        sums = out["vocab"].groupBy("term").agg(F.sum("doc").alias("doc"), F.sum("cnt").alias("cnt"))
        # Counts may be lost to older segments, whose terms are in gram indexes of their own.
        out |= vocabulary_tables(sums.filter("doc > 0" if oldest else "doc <> 0 or cnt <> 0"))
    if not oldest:
        # Of what is gone, what older segments hold is still to be named.
        if "dead_chunks" in rows:
            out["dead_chunks"] = rows["dead_chunks"].join(rows["chunks"].select("chunk_id"), "chunk_id", "left_anti") if "chunks" in rows else rows["dead_chunks"]
        if "dead_sessions" in rows:
            out["dead_sessions"] = rows["dead_sessions"].groupBy("session_id").agg(F.max("before").alias("before"))
    return store.write(out, v, instead=part)


def compact(store: Store) -> None:
    """Write all that is alive to one segment."""
    v = store.version()
    merge_segments(store, v, slice(0, len(v.segments)))


def _log(store: Store, v: Version, began, report: Report) -> dict[str, DataFrame]:
    runs = store.read("runs", v)
    number = 1 + ((runs.agg(F.max("run_id")).first()[0] or 0) if runs is not None else 0)
    row = store.spark.createDataFrame([(number, began, report.scanned, report.indexed, report.chunks, report.errors)], "run_id long, started_at timestamp, files_scanned long, files_indexed long, chunks_created long, errors array<string>")
    return {"runs": row.withColumn("ended_at", F.current_timestamp())}


def delete_session(store: Store, session_id: str) -> None:
    """Take one session out of all tables."""
    v = store.version()
    dead = materialize(store.read("chunks", v).filter(F.col("session_id") == session_id).select("chunk_id"), "dead")
    gone = store.spark.createDataFrame([(session_id, v.number + 1)], "session_id string, before long")
    store.write({"dead_chunks": dead, "dead_sessions": gone, "vocab": without(store, v, dead)}, v)


def backfill(store: Store, provider: Provider) -> None:
    """Embed the chunks that have no vector."""
    v = store.version()
    chunks, vectors = store.read("chunks", v), store.read("vectors", v)
    missing = chunks if vectors is None else chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    fresh, cache = embed_with_cache(missing, store.read("cache", v), provider)
    store.write({"vectors": fresh, "cache": cache}, v)
