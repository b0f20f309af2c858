"""Vector code compression: product codebooks by Lloyd's method, kept up by differences.

Vectors are cut into PARTS equal consecutive parts, their components made integers floor(SCALE * x), and each part is
written as the number of the nearest entry of its position's codebook (squared Euclidean distance, ties to the lower
number). A codebook starts as that part of the ENTRIES smallest identifiers. Each round assigns all parts and then
replaces an entry by the componentwise floor(sum / count) of its parts; entries without parts stay.

Sums are never taken anew. The state of a round is a table with each row's previous and new numbers, and a table of
running integer sums and counts by part position, entry and component, both in the shared folder. What a round shuffles
are the differences: a part whose number changed is taken from the sums of its old entry and added to those of its new
one, summed within a task first; parts that stay where they were send nothing. A task sends, and the driver reads, at
most as many rows as the codebooks have integers (times the limbs of a number), whatever the number of vectors.

All arithmetic is exact: distances are matrix products of doubles while they stay below 2^53, else Python's integers;
sums travel as limbs of 32 bits in longs. Row order and partitions therefore change nothing.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped, as are vectors
whose length is no positive multiple of PARTS or not that of the smallest identifier left. Fewer than ENTRIES rows give
as many entries. Repeated rows and identifiers are rows like others, in the order of their vectors where identifiers tie;
null identifiers come last. An empty table gives an empty result. Errors beyond a long are its largest value. Labels may
be of any type, nulls are one label; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.llm.workers import give_back
from retrospark.storage import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
EXACT, MOST, LIMB = 1 << 53, (1 << 63) - 1, 32
BLOCK_ROWS = 2048


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): doubles where these are exact in sums of squares, else Python's integers."""
    small = np.abs(x).max(initial=0) < 2**40
    return np.floor(scale * x) if small else np.array([int(v) * scale if abs(v) >= EXACT else math.floor(scale * v) for v in x.ravel().tolist()], object).reshape(x.shape)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of x the number of the nearest row of book, the lowest of several, and the squared distance."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < EXACT:
        x, book = x.astype(float), book.astype(float)
        d = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    else:
        whole = np.vectorize(int, otypes=[object])
        d = ((whole(x)[:, None, :] - whole(book)[None, :, :]) ** 2).sum(2)
    at = np.argmin(d, 1)
    return at, d[np.arange(len(x)), at]


def _limbs(value: int) -> list[int]:
    """value in base 2^LIMB, least first, all of its sign."""
    sign, value, out = (-1, -value, []) if value < 0 else (1, value, [])
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


@dataclass
class Codebooks:
    """entries: an array (parts, entries, components of a part) of integers."""

    entries: np.ndarray
    scale: int = SCALE

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel()).encode()).hexdigest()


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int = PARTS) -> DataFrame:
    """id, label, v: the rows whose vector can be cut into parts."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), v.alias("v"))
    # NaN is greater than infinity in Spark; a null component makes the comparison null.
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & finite)


def _batches(batches: Iterator[pa.RecordBatch], dim: int, parts: int, scale: int):
    """Blocks of rows: the record batch, and its integers as (rows, parts, components)."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            b = batch.slice(i, BLOCK_ROWS)
            x = b.column(b.schema.names.index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield b, integers(x, scale).reshape(len(x), parts, dim // parts)


def _numbers(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Numbers of all parts as (rows, parts), and each row's squared distances in all."""
    at, d = zip(*(nearest(x[:, p], books[p]) for p in range(books.shape[0])), strict=True)
    error = [min(MOST, sum(int(v) for v in row)) for row in zip(*d, strict=True)]
    return np.stack(at, 1).astype(np.uint8), error


def _binary(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes], pa.binary())


def assign(state: DataFrame, books: Codebooks) -> DataFrame:
    """state with `was` (the numbers of the round before, null at first), `code` (new numbers) and `error`."""
    entries, scale = books.entries, books.scale
    parts, dim = entries.shape[0], entries.shape[0] * entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _batches(batches, dim, parts, scale):
            code, error = _numbers(x, entries)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "v", "code")), _binary(code), pa.array(error, pa.int64())], names=["id", "label", "v", "was", "code", "error"])
        give_back()

    before = state.select("id", "label", "v", "code") if "code" in state.columns else state.select("id", "label", "v", F.lit(None).cast("binary").alias("code"))
    kind = before.schema["label"].dataType.simpleString()
    return before.mapInArrow(run, f"id long, label {kind}, v array<double>, was binary, code binary, error long")


def changes(state: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, place (-1: the count), limb, value: what parts with a new number take from the old entry and add to the new."""
    shape, scale = books.entries.shape, books.scale
    parts, dim = shape[0], shape[0] * shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
        for b, x in _batches(batches, dim, parts, scale):
            code = np.frombuffer(b"".join(b.column(b.schema.names.index("code")).to_pylist()), np.uint8).reshape(-1, parts)
            was = b.column(b.schema.names.index("was")).to_pylist()
            had = np.array([w is not None for w in was])
            old = np.frombuffer(b"".join(w or bytes(parts) for w in was), np.uint8).reshape(-1, parts)
            moved = ~had[:, None] | (old != code)
            exact = x.dtype != object and len(x) * np.abs(x).max(initial=0) < EXACT
            for p in range(parts):
                for sign, who, rows in ((1, code[:, p], moved[:, p]), (-1, old[:, p], moved[:, p] & had)):
                    counts[p] += sign * np.bincount(who[rows], minlength=shape[1])
                    for j in range(shape[2]) if rows.any() else ():
                        if exact:
                            sums[p, :, j] += np.array([sign * int(v) for v in np.bincount(who[rows], x[rows, p, j], shape[1])], object)
                        else:
                            for e, v in zip(who[rows].tolist(), x[rows, p, j].tolist(), strict=True):
                                sums[p, e, j] += sign * int(v)
        out = [(p, e, -1, 0, int(c)) for (p, e), c in np.ndenumerate(counts) if c]
        out += [(p, e, j, i, limb) for (p, e, j), v in np.ndenumerate(sums) for i, limb in enumerate(_limbs(int(v)))]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "entry", "place", "limb", "value"])
        give_back()

    moved = state.filter(F.col("was").isNull() | (F.col("was") != F.col("code")))
    return moved.select("v", "was", "code").mapInArrow(run, "part int, entry int, place int, limb int, value long")


def replaced(books: Codebooks, running: DataFrame) -> Codebooks:
    """Entries with parts become floor(sum / count)."""
    entries = books.entries.astype(object)
    counts, sums = np.zeros(entries.shape[:2], object), np.zeros(entries.shape, object)
    for r in running.collect():  # at most the codebooks' integers, times limbs
        if r.place < 0:
            counts[r.part, r.entry] += r.value << LIMB * r.limb
        else:
            sums[r.part, r.entry, r.place] += r.value << LIMB * r.limb
    for (p, e), n in np.ndenumerate(counts):
        if n:
            entries[p, e] = [s // n for s in sums[p, e]]
    return Codebooks(entries, books.scale)


def train(rows: DataFrame, parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Codebooks | None, DataFrame]:
    """The codebooks, and rows (id, label, v, and the last round's `code`) that are all of one length. No rows: None.

    rows: as kept() gives them.
    """
    order = (F.col("id").asc_nulls_last(), F.col("v"))
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return None, rows
    state = rows.filter(F.size("v") == len(first[0].v))
    seeds = state.orderBy(*order).limit(n_entries).collect()
    x = integers(np.array([r.v for r in seeds], float), scale)
    books = Codebooks(x.reshape(len(x), parts, -1).transpose(1, 0, 2).astype(object), scale)
    running, written = None, []
    for _ in range(rounds):
        state = materialize(assign(state, books), "codes")
        delta = changes(state, books)
        total = delta if running is None else running.unionByName(delta)
        running = materialize(total.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")), "sums")
        books = replaced(books, running)
        discard(*written)
        written = [state, running]
    if running is not None:
        discard(running)
    return books, state


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code binary: a byte a part, error long) of each kept vector, and the codebooks, None if no vector is kept."""
    if not 0 < n_entries <= 256:
        raise ValueError("a number has one byte")
    rows = kept(vectors, id_col, vector_col, label_col, parts)
    books, state = train(rows, parts, n_entries, rounds, scale)
    if books is None:
        return rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None
    return assign(state, books).select("id", "label", "code", "error"), books


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", out_col: str = "approximate") -> DataFrame:
    """codes with one more column, the vector that a code stands for."""
    entries, n = books.entries.astype(float) / books.scale, codes.columns.index(code_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            v = np.concatenate([entries[p][at[:, p]] for p in range(entries.shape[0])], 1) if b.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(v), pa.list_(pa.float64()))], names=[*b.schema.names, out_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)
    return codes.mapInArrow(run, f"{kinds}, `{out_col}` array<double>")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the errors of all rows of the label; a label that holds many rows meets them with one."""
    codes = materialize(codes, "encoded")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = codes.groupBy("label").agg(F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
