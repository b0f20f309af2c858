"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder of this process, in local mode only: on a
    cluster each executor would write to its own disk."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="retrospark-")
    return _own_folder


def materialize(df: DataFrame, name: str = "step", max_rows: int = 0) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, with at most max_rows in a file (0: any number).

    This cuts lineage: a lost executor costs the tasks of the current step only, and no row is computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", max_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def settle(df: DataFrame, name: str, most: int = 1000, costly: bool = False) -> DataFrame:
    """df computed once: as rows of the plan where there are at most `most`, else as materialize() does. What is settled stays so.

    Where there may be more, and what df reads is large, `costly` writes first and looks then.
    """
    if hasattr(df, "_rows") or hasattr(df, "_scratch"):
        return df
    written = materialize(df, name) if costly else None
    table = (df if written is None else written).limit(most + 1).toArrow()
    if table.num_rows > most:
        return materialize(df, name) if written is None else written
    if written is not None:
        discard(written)
    # From Arrow it is a local relation, whose size Spark knows; from rows it would be an RDD of unknown size.
    out = df.sparkSession.createDataFrame(table, df.schema)
    out._rows = [Row(**r) for r in table.to_pylist()]
    return out


def rows_of(df: DataFrame) -> list[Row] | None:
    """The rows of a frame that settle() made a part of its plan."""
    return getattr(df, "_rows", None)


#: Ranges of keys that a look-up names at most.
RANGES = 64


def ranges(keys: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that hold all keys, parted at the widest gaps."""
    keys = sorted(set(keys))
    gaps = sorted(range(1, len(keys)), key=lambda i: keys[i - 1] - keys[i])[: most - 1]
    cuts = [0, *sorted(gaps), len(keys)]
    return [(keys[i], keys[j - 1]) for i, j in zip(cuts, cuts[1:], strict=False) if i < j]


def look_up(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among those asked for, a frame that settle() gave: where it is few rows, a scan of a table
    in ranges of the key passes over the files and row groups between them. A join has to follow."""
    if (few := rows_of(asked)) is None:
        return rows
    keys = [r[key] for r in few if r[key] is not None]
    parts = [F.col(key).between(a, b) for a, b in ranges(keys)]
    return rows.filter(reduce(lambda a, b: a | b, parts)) if parts else rows.filter(F.lit(False))


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for these frames. Nothing that is read later may depend on them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df with a number for each row, and the number's column. Written once, so that whatever reads it sees one number
    for a row, however df came about."""
    column = unused(df, "row")
    return materialize(df.withColumn(column, F.monotonically_increasing_id()), name), column


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name
