"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition makes one run, sorted by (digest, length, second hash), of digests with the identifier that stays
and the number of rows. Runs are exchanged in binomial rounds: in round k, the runs whose numbers agree but for their
lowest k bits meet, two merged runs at a time, and equal digests keep one identifier. After ceil(log2(partitions)) rounds
one run is left. An exchange deals a run by digest, so all executors merge at once, and each merges sorted input: Spark's
aggregate over sorted rows, which holds one digest at a time. A hot text is one row for each run from the start, so no task
ever gathers the rows of a group.

Digests are SHA-256; rows count as equal only when byte length and an independent 64-bit hash agree as well, which is
verified at every level as they are part of the merge key.

Defined results: a null text counts as empty, so nulls and empty texts form one group; rows with a null identifier
take part, and a group of only such rows keeps null; repeated identifiers with one text count as separate rows, all
marked kept if theirs is the identifier that stays; an empty table gives an empty table. Other columns are ignored,
whatever their names. Frames of any kind will do: what is compared is written once before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrospark.storage import discard, materialize, numbered, unused

KEY = ["digest", "n_bytes", "check_hash"]


def digests(df: DataFrame, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    """KEY, doc_id, row (a number that tells rows of one identifier apart), run (the input partition)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check_hash"),
        F.col(id_col).cast("long").alias("doc_id"), (F.lit(0).cast("long") if row is None else row).alias("row"), F.spark_partition_id().alias("run"),
    )


def merge_runs(rows: DataFrame, keep: str = "max") -> DataFrame:
    """One row for each distinct text: KEY, keep (struct with doc_id and row), group_size. rows: written digests()."""
    best = F.max if keep == "max" else F.min
    known = F.col("doc_id").isNotNull() if keep == "max" else F.col("doc_id").isNull()
    # A struct can't be changed in place, so Spark aggregates over sorted rows instead of in a hash table.
    runs = rows.select(*KEY, "run", F.struct(known.alias("known"), "doc_id", "row").alias("keep"), F.lit(1).cast("long").alias("group_size"))
    last = rows.agg(F.max("run")).first()[0] or 0
    for _ in range(max(1, int(last).bit_length())):
        runs = runs.withColumn("run", F.shiftright("run", 1)).groupBy(*KEY, "run").agg(best("keep").alias("keep"), F.sum("group_size").alias("group_size"))
    return runs.drop("run")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    rows = materialize(digests(df, id_col, text_col), "digests")
    groups = materialize(merge_runs(rows, keep), "digest-runs").filter("group_size > 1")
    # Only groups of two rows and more come to the join; a hot digest meets one row there, so that AQE can split it.
    joined = rows.join(groups, KEY, "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    return joined.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes",
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """df with one row for each distinct text, all columns kept. Of rows that share identifier and text, one stays."""
    names = df.columns
    own, row = numbered(df, "numbered")
    dropped = unused(own, "dropped")
    rows = materialize(digests(own, id_col, text_col, F.col(row)), "digests")
    groups = materialize(merge_runs(rows, keep), "digest-runs")
    repeated = groups.filter("group_size > 1")
    gone = materialize(rows.join(repeated, KEY).filter(F.col("row") != F.col("keep.row")).select(F.col("row").alias(dropped)), "copies")
    discard(rows, groups)
    return own.join(gone, F.col(row) == F.col(dropped), "left_anti").select(*names)
