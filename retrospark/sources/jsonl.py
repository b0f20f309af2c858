"""Session logs: folders of JSONL files.

A file is never a row: it is read in splits by byte offset, as Spark's text reader cuts it, a line belonging to the split
where it starts. Lines are numbered within their split as they are read; then the splits' counts, added up along
each file, give physical line numbers. So files of any size are read by many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrospark import lexicons
from retrospark.functions import text as T
from retrospark.operators.sessions import NO_BLOCKS
from retrospark.storage import materialize

LONG_BLOCK = 3000
#: Files up to which a task hashes the whole, lines of a larger one that are hashed together, and files that a plan may name.
WHOLE_BYTES, GROUP_LINES, NAMED_FILES = 128 << 20, 4096, 1000
NO_LINES = "file_path string, start long, at long, raw string"


def _load(spark: SparkSession, kind: str, root: str | list[str], **options: str) -> DataFrame | None:
    """The *.jsonl files of a folder, or those named; None if there are none. A file that can't be read gives no rows."""
    reader = spark.read.format(kind).options(recursiveFileLookup="true", ignoreCorruptFiles="true", ignoreMissingFiles="true", **options)
    reader = reader if isinstance(root, list) else reader.option("pathGlobFilter", "*.jsonl")
    try:
        return reader.load(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _path(name: str = "_metadata.file_path") -> Column:
    """A file's path as it is written, local ones without their scheme."""
    plain = F.url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "/")


def listing(spark: SparkSession, root: str, include_subagents: bool = False) -> DataFrame:
    """file_path, file_size, project_dir, parent_session_id, is_subagent of all *.jsonl below root, none of which is opened.

    A root that isn't there gives no rows.
    """
    files = _load(spark, "binaryFile", root)
    if files is None:
        files = spark.createDataFrame([], "file_path string, file_size long")
    else:
        files = files.select(_path().alias("file_path"), F.col("length").alias("file_size"))
    path = F.col("file_path")
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    below = F.substr(path, F.instr(path, base) + len(base))
    files = files.select(path, "file_size", F.split_part(below, F.lit("/"), F.lit(1)).alias("project_dir"), parent_session(path).alias("parent_session_id"), F.contains(path, F.lit("subagent")).alias("is_subagent"))
    return files if include_subagents else files.filter("not is_subagent")


def scan(spark: SparkSession, root: str, include_subagents: bool = False, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """listing() with file_hash, null for files that can't be read to their end.

    The hash is SHA-256 of a file's bytes up to whole_bytes; of larger ones, which no task takes whole, of the hashes of
    their groups of lines.
    """
    files = listing(spark, root, include_subagents)
    rows = _load(spark, "binaryFile", root)
    if rows is None:
        return files.withColumn("file_hash", F.lit(None).cast("string"))
    small = rows.filter(F.col("length") <= whole_bytes).select(_path().alias("p"), F.sha2("content", 256).alias("file_hash"), F.octet_length("content").cast("long").alias("read"))
    large = _numbered(_splits(spark, root, F.col("_metadata.file_size") > whole_bytes))
    group = F.floor((F.col("line") - 1) / GROUP_LINES)
    ordered = lambda i, h: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), h.alias("h")))), lambda x: x["h"]), ""), 256)
    groups = large.withColumn("g", group).groupBy("file_path", "g").agg(ordered("line", F.sha2(F.col("raw").cast("binary"), 256)).alias("h"), F.sum(F.octet_length("raw") + 1).alias("read"))
    large = groups.groupBy("file_path").agg(ordered("g", F.col("h")).alias("file_hash"), F.sum("read").alias("read"))
    hashes = small.unionByName(large.withColumnRenamed("file_path", "p"))
    # The last line may lack its end.
    whole = F.when(F.col("read") >= F.col("file_size"), F.col("file_hash"))
    return files.join(hashes, F.col("file_path") == F.col("p"), "left").withColumn("file_hash", whole).drop("p", "read")


def _splits(spark: SparkSession, root: str | list[str], files: Column | None = None) -> DataFrame:
    """file_path, start (of the split), at (rising along a split), raw: the lines of files as they are read."""
    rows = _load(spark, "text", root, lineSep="\n")
    if rows is None:
        return spark.createDataFrame([], NO_LINES)
    rows = rows if files is None else rows.filter(files)
    return rows.select(_path().alias("file_path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of _splits(), written once, with their physical line from 1 in place of start and at."""
    rows = materialize(rows, "lines")
    w = Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file_path", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    line = (F.col("at") - F.col("first") + F.col("before") + 1).cast("int").alias("line")
    return rows.join(splits.drop("n"), ["file_path", "start"]).select("file_path", line, *[c for c in rows.columns if c not in ("file_path", "start", "at")])


def parent_session(path: Column) -> Column:
    parts = F.split(path, "/")
    at = F.array_position(parts, "subagents")
    return F.when(at > 1, F.element_at(parts, (at - 1).cast("int")))


def with_status(files: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """status: new, unchanged, changed (it grew), changed_nonmonotonic, or unreadable (without a hash)."""
    if sessions is None:
        return files.withColumn("status", F.when(F.col("file_hash").isNull(), "unreadable").otherwise("new"))
    known = sessions.select(F.col("file_path").alias("k"), F.col("file_hash").alias("known_hash"), F.col("file_size").alias("known_size")).dropDuplicates(["k"])
    status = F.when(F.col("file_hash").isNull(), "unreadable").when(F.col("k").isNull(), "new").when(F.col("file_hash") == F.col("known_hash"), "unchanged").when(F.col("file_size") > F.col("known_size"), "changed").otherwise("changed_nonmonotonic")
    return files.join(known, F.col("file_path") == F.col("k"), "left").withColumn("status", status).drop("k", "known_hash", "known_size")


def changed(files: DataFrame) -> DataFrame:
    return files.filter(F.col("status").isin("new", "changed", "changed_nonmonotonic"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def visible_text(content: Column) -> Column:
    """Text to read: a string as it is, or the text blocks of an array, between blank lines."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: _text(b, "$.type") == "text"), lambda b: T.strip(F.coalesce(_text(b, "$.text"), F.lit(""))))
    joined = F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")
    return F.when(F.schema_of_variant(content) == "STRING", T.strip(_text(content, "$"))).otherwise(F.coalesce(joined, F.lit("")))


def selective_blocks(content: Column) -> Column:
    """Thinking and tool results with a marker, long ones cut to the part around it."""

    def one(b: Column) -> Column:
        raw = F.try_variant_get(b, "$.content", "array<variant>")
        parts = F.array_join(F.transform(F.filter(raw, lambda p: F.schema_of_variant(p).startswith("OBJECT")), lambda p: F.coalesce(_text(p, "$.text"), F.lit(""))), "\n")
        kind = _text(b, "$.type")
        text = T.strip(F.coalesce(F.when(kind == "thinking", _text(b, "$.thinking")).when(kind == "tool_result", F.coalesce(parts, _text(b, "$.content"))), F.lit("")))
        text = F.when(F.length(text) > LONG_BLOCK, T.relevant_section(text, lexicons.SELECTIVE_MARKERS)).otherwise(text)
        return F.struct(F.when(kind == "thinking", "thinking").otherwise("tool_context").alias("role"), text.alias("text"))

    blocks = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda b: _text(b, "$.type").isin("thinking", "tool_result"))
    marked = F.filter(F.transform(blocks, one), lambda s: (s["text"] != "") & T.contains_any(s["text"], lexicons.SELECTIVE_MARKERS))
    return F.coalesce(marked, F.array().cast(NO_BLOCKS))


def parsed(rows: DataFrame) -> DataFrame:
    """What a line says, in place of raw: utf8 (whether it can be read), and, null where it is no JSON object, the entry's fields."""
    rest = [c for c in rows.columns if c != "raw"]
    good = F.is_valid_utf8("raw")
    v = F.when(good, F.try_parse_json(T.strip(F.col("raw"))))
    rows = rows.select(*rest, good.alias("utf8"), v.alias("v")).withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    v = F.col("v")
    return rows.select(
        *rest, "utf8", v.isNotNull().alias("is_entry"), _text(v, "$.uuid").alias("uuid"), _text(v, "$.parentUuid").alias("parent_uuid"), F.coalesce(_text(v, "$.type"), F.lit("")).alias("type"), F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"),
        _text(v, "$.timestamp").alias("ts_text"), _text(v, "$.sessionId").alias("session_ref"), _text(v, "$.title").alias("title"), F.coalesce(F.when(v.isNotNull(), visible_text(F.try_variant_get(v, "$.message.content", "variant"))), F.lit("")).alias("text"),
        F.when(_text(v, "$.type") == "assistant", selective_blocks(F.try_variant_get(v, "$.message.content", "variant"))).otherwise(F.array().cast(NO_BLOCKS)).alias("blocks"),
    )


def read(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """All lines of files (rows of scan()), parsed, with their physical line: blank and broken ones are there too, and count."""
    paths = [r.file_path for r in files.select("file_path").limit(NAMED_FILES + 1).collect()]
    if not paths:
        return _numbered(parsed(spark.createDataFrame([], NO_LINES)))
    if len(paths) <= NAMED_FILES:
        scheme = "file://" if root.startswith(("/", "file:")) else ""
        return _numbered(parsed(_splits(spark, [_literal(scheme + p) for p in paths])))
    return _numbered(parsed(_splits(spark, root).join(files.select("file_path"), "file_path", "left_semi")))


def _literal(path: str) -> str:
    """A path in which nothing stands for anything else."""
    return re.sub(r"([*?\[\]{}\\,])", r"\\\1", path)


def unreadable(rows: DataFrame) -> DataFrame:
    """file_path of files with a line that is no UTF-8. rows: as read() gives them."""
    return rows.filter(~F.col("utf8")).select("file_path").distinct()


def messages(rows: DataFrame) -> DataFrame:
    """The message table of parsed lines. A session's identifier is that of its first system entry, else the file's name."""
    rows = rows.filter("is_entry").drop("utf8", "is_entry")
    own = rows.groupBy("file_path").agg(F.min_by("session_ref", F.when((F.col("type") == "system") & (F.col("session_ref") != ""), F.col("line"))).alias("ref"))
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.jsonl$", "")
    return rows.join(own, "file_path").withColumn("session_id", F.coalesce("ref", stem)).drop("ref")
