"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of five lower-cased words. Each element is the seed of a Poisson process that
drops points on m registers; a register keeps its smallest point, on an exponential scale, truncated to 16 bits. So
registers of two sets merge by the larger value, and are equal with a probability near the sets' similarity.

1. Documents with equal sets form one class, led by the smallest identifier.
2. The registers of a class are cut into bands. Classes that share a band share a bucket; a bucket of any size costs one
   row for each class.
3. Pods: a class sits with the smallest of all first members of its buckets. A pod with many seats is dealt, by hash, over
   chunks of bounded size, and only its first member sits in each chunk. In a chunk, the similarity of all pairs that
   aren't connected yet is estimated jointly, by likelihood, from how many registers are larger, equal and smaller; pairs
   that may reach the threshold are verified on the full sets. Only the links of a spanning forest leave the task, fewer
   than it has seats. Groups of near copies, however large, are connected by then.
4. Buckets that still hold several components, of several chunks, are open: all pairs in them across components are looked
   at in the same way, starting from the components known so far, and links between components come out. An open bucket
   of more than one chunk is worked on by pairs of chunks; that is the exact way for buckets of any size.
5. Bands and estimates pass over a pair at the threshold 2 in 100,000 times. So what they left apart is looked at without
   chance: in one order of all shingles, the common ones last, the first shingle of two sets that reach the threshold is
   among the first n - ceil(percent * n / 100) + 1 of each, and among fewer of the smaller. Documents of several components
   with such a shingle in common are compared by the parities of their sets' elements, which bound the symmetric difference from below. Pairs that may
   reach the threshold are candidates; the groups that they form are compared on the full sets, in chunks like buckets.
6. The components of all links are the result.

Defined results: null texts and texts without words have an empty set, link with nothing and are their own component; texts
with fewer than five words have their word sequence as the only shingle; equal sets always link; rows that share an
identifier are one document with all their links, each row with its own set's size; rows with a null identifier give a row with null component and kept false, and take no part; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrospark.components import connected_components
from retrospark.llm.hashing import U64, mix, shingle_sets
from retrospark.llm.workers import give_back
from retrospark.storage import discard, materialize, unused

REGISTERS, BAND = 200, 5
BASE, RATE = 1.001, 20.0
CHUNK_SETS, CHUNK_SHINGLES = 2048, 2_000_000
BATCH_BYTES = 1 << 20
SAMPLE_ROWS, COMMON_IN_SAMPLE, MOST_COMMON = 4096, 4, 1 << 16
FIRSTS_IN_BUCKET, FIRSTS_AT_ONCE = 1 << 18, 1 << 17
IDS_TO_ALL = 1 << 20


def setsketch(values: np.ndarray, offsets: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers, uint16, of several sets: a matrix of sets by m. Empty sets have zeros."""
    n_sets = len(offsets) - 1
    of = np.repeat(np.arange(n_sets), np.diff(offsets))
    points = np.full(n_sets * m, np.inf)
    state, x = values.astype(U64), np.zeros(len(values))
    step = U64(0x9E3779B97F4A7C15)
    while len(of):
        state = state + step
        h = mix(state)
        # 32 bits choose the register, the rest the distance to the next point.
        x = x - np.log(((h >> U64(32)).astype(np.float64) + 0.5) * 2.0**-32) / (RATE * m)
        register = ((h & U64(0xFFFFFFFF)) * U64(m)) >> U64(32)
        np.minimum.at(points, of * m + register.astype(np.int64), x)
        alive = x < points.reshape(n_sets, m).max(axis=1)[of]
        state, x, of = state[alive], x[alive], of[alive]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(points) / np.log(BASE))
    k[np.isinf(points)] = 0
    return np.clip(k, 0, 65535).astype(np.uint16).reshape(n_sets, m)


def joint_similarity(larger: np.ndarray, smaller: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most likely similarity, given how many registers of a are larger and smaller than those of b, and set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-12)) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    equal = m - larger - smaller

    def likelihood(j):
        plus, minus = np.maximum(p(u - v * j), 1e-9), np.maximum(p(v - u * j), 1e-9)
        return larger * np.log(plus) + smaller * np.log(minus) + equal * np.log(np.maximum(1 - plus - minus, 1e-9))

    for _ in range(18):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Rows of a batch and their texts, in groups of about BATCH_BYTES."""
    texts, start = batch.column(1), 0
    while start < len(texts):
        group: list[bytes | None] = []
        size = 0
        while start + len(group) < len(texts) and (not group or size < BATCH_BYTES) and len(group) < 1000:
            value = texts[start + len(group)].as_py()
            group.append(value)
            size += len(value or b"")
        yield batch.slice(start, len(group)), group
        start += len(group)


def _bytes(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("t"), *more)


def parities(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Of each set a power of two of bits, at least as many as elements and 64: each the parity of the elements that fall
    on it. Two sets differ in as many elements as parities, or more. Half the bits are the two halves' exclusive or."""
    n = np.diff(offsets)
    words = 1 << np.ceil(np.log2(np.maximum(n / 64, 1))).astype(np.int64)
    ends = np.cumsum(words)
    of = np.repeat(np.arange(len(n)), n)
    at = values & (words[of] * 64 - 1).astype(U64)
    bits = np.zeros(words.sum(), U64)
    np.bitwise_xor.at(bits, (ends - words)[of] + (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
    return [b.tobytes() for b in np.split(bits, ends[:-1])]


def sketch_documents(df: DataFrame, id_col: str, text_col: str, sets: bool, width: int = 5, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, bits, digest, bands; with sets, doc_id, n, bits, regs, items. more: columns of df that stay."""
    blobs = _bytes(df, id_col, text_col, *more)
    schema = "doc_id long, n long, bits binary, " + ("regs binary, items binary" if sets else "digest binary, bands array<long>")
    schema += "".join(f", {c} {kind}" for c, kind in blobs.dtypes[2:])

    def digest_of(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """128 bits of each set: two sums of mixed elements."""
        two = np.zeros((len(offsets) - 1, 2), U64)
        full = np.diff(offsets) > 0
        for k, part in enumerate((values, mix(values ^ U64(0xA5A5A5A5A5A5A5A5)))):
            if len(part):
                two[full, k] = np.add.reduceat(mix(part), offsets[:-1][full])
        return [d.tobytes() for d in two]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, group in _groups(batch):
                values, offsets = shingle_sets(group, width)
                n, regs = np.diff(offsets), setsketch(values, offsets)
                columns = {"doc_id": rows.column(0), "n": pa.array(n, pa.int64()), "bits": pa.array(parities(values, offsets), pa.binary())}
                if sets:
                    columns["regs"] = pa.array([r.tobytes() for r in regs], pa.binary())
                    columns["items"] = pa.array([values[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(group))], pa.binary())
                else:
                    bands = [b if full else None for b, full in zip(band_keys(regs), n > 0, strict=True)]
                    columns |= {"digest": pa.array(digest_of(values, offsets), pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))}
                columns |= {c: rows.column(2 + k) for k, c in enumerate(more)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        give_back()

    return blobs.mapInArrow(run, schema)


def band_keys(regs: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key for each band of each row, with the band's place in the low byte."""
    n, m = regs.shape
    grouped = regs.reshape(n, m // band, band).astype(U64)
    key = np.arange(m // band, dtype=U64)[None, :] + np.zeros((n, 1), U64)
    for j in range(band):
        key = mix(key * U64(0x9E3779B97F4A7C15) + grouped[:, :, j] + U64(1))
    return (key & ~U64(0xFF) | np.arange(m // band, dtype=U64)).view(np.int64)


def links_of_group(label: np.ndarray, n: np.ndarray, regs: np.ndarray, items: list[np.ndarray], side: np.ndarray, band: int | None, percent: int, slack: float) -> list[tuple[int, int]]:
    """Links that join components, as pairs of labels. label: what is connected already; side: which chunk a row is
    from; with two chunks only pairs across count; band: only pairs whose first common band it is count, if given."""
    out: list[tuple[int, int]] = []
    order = np.argsort(n, kind="stable")
    label, n, regs, side, items = label[order], n[order], regs[order], side[order], [items[i] for i in order]
    m, mixed = regs.shape[1], len(np.unique(side)) > 1
    for i in range(len(label) - 1):
        upto = np.searchsorted(n, n[i] * 100 // percent, side="right")  # larger sets can't reach the threshold
        near = i + 1 + np.flatnonzero(label[i + 1 : upto] != label[i])
        if mixed:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        # A quick look before the likelihood: equal registers are about as many as the similarity says.
        same = regs[near] == regs[i]
        equal = same.sum(axis=1)
        quick = equal >= m * (percent / 100 - 1.6 * slack)
        if band is not None:
            quick &= same.reshape(len(near), -1, BAND).all(axis=2).argmax(axis=1) == band
        near, equal = near[quick], equal[quick]
        if not len(near):
            continue
        larger = (regs[i] > regs[near]).sum(axis=1)
        j = joint_similarity(larger, m - equal - larger, m, np.full(len(near), float(n[i])), n[near].astype(float))
        for k in near[j >= percent / 100 - slack]:
            if label[k] == label[i]:
                continue
            common = len(np.intersect1d(items[i], items[k], assume_unique=True))
            if 100 * common >= percent * (n[i] + n[k] - common):
                low, high = sorted((int(label[i]), int(label[k])))
                out.append((high, low))
                label[label == high] = low
    return out


def links_of_tasks(rows: DataFrame, percent: int, slack: float) -> DataFrame:
    """a, b: what links_of_group finds. rows: task, part, side, band, label, n, regs, items; a part lies in one task."""

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, g in pdf.groupby("part", sort=False):
            regs = np.frombuffer(b"".join(g.regs), np.uint16).reshape(len(g), -1)
            items = [np.frombuffer(x, U64) for x in g["items"]]
            band = None if g.band.isna().all() else int(g.band.iloc[0])
            out += links_of_group(g.label.to_numpy().copy(), g.n.to_numpy(), regs, items, g.side.to_numpy(), band, percent, slack)
        give_back()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("task").applyInPandas(verify, "a long, b long")


def _chunks() -> Column:
    """Of a group: how many chunks its members fill."""
    return F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks")


def _task(seats: DataFrame, *chunk: str) -> DataFrame:
    """seats with a task: small parts share tasks of about a chunk's size, the chunks of large ones have their own."""
    rows, shingles = seats.filter("chunks = 1").agg(F.count(F.lit(1)), F.sum("n")).first()
    bins = 1 + max(rows // CHUNK_SETS, (shingles or 0) // CHUNK_SHINGLES)
    shared = F.concat(F.lit("b"), F.pmod(F.xxhash64("part"), F.lit(bins)))
    return seats.withColumn("task", F.when(F.col("chunks") == 1, shared).otherwise(F.concat_ws(":", "part", *chunk)))


def _across(seats: DataFrame) -> DataFrame:
    """seats with a task for each pair of chunks of a part, and the side that they are on in it."""
    across = seats.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    across = across.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    return _task(across, "low", "high").withColumnRenamed("chunk", "side")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))


def pod_leads(classes: DataFrame) -> DataFrame:
    """id, pod, n, bands of each class that shares a bucket: the smallest first member of its buckets, and those buckets."""
    keyed, bucket = classes.select("id", "n", F.explode("bands").alias("band")), Window.partitionBy("band")
    met = keyed.select("id", "n", "band", F.min("id").over(bucket).alias("first"), F.max("id").over(bucket).alias("last")).filter("first < last")
    return met.groupBy("id").agg(F.min("first").alias("pod"), F.max("n").alias("n"), F.collect_list("band").alias("bands"))


def pod_seats(leads: DataFrame) -> DataFrame:
    """id, n, pod, chunk, chunks: where each class that shares a bucket sits; a pod's first member sits in each of its chunks."""
    guests = leads.filter("id <> pod")
    sizes = guests.groupBy("pod").agg(_chunks())
    guests = guests.join(sizes, "pod").select("id", "n", "pod", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "chunks")
    hosts = sizes.join(leads.select("id", "n"), F.col("pod") == F.col("id")).select("id", "n", "pod", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks")
    return guests.union(hosts)


def open_seats(leads: DataFrame, seats: DataFrame, components: DataFrame) -> DataFrame:
    """id, n, label, band, part, chunk, chunks of the classes in buckets that hold several components of several chunks."""
    at = seats.groupBy("id").agg(F.min(F.struct(F.col("id") == F.col("pod"), "pod", "chunk")).alias("s"))
    at = at.join(components, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("label"), F.xxhash64("s.pod", "s.chunk").alias("sat"))
    keyed = leads.join(at, "id").select("id", "n", "label", "sat", F.explode("bands").alias("part"))
    buckets = keyed.groupBy("part").agg(_chunks(), F.min("label").alias("l"), F.max("label").alias("h"), F.min("sat").alias("p"), F.max("sat").alias("q"))
    buckets = buckets.filter("l < h and p < q").select("part", "chunks")
    band = F.col("part").bitwiseAND(F.lit(0xFF)).cast("int").alias("band")
    return keyed.join(buckets, "part").select("id", "n", "label", band, "part", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "chunks")


def common_shingles(df: DataFrame, rows: int, width: int) -> np.ndarray:
    """In order, shingles that several documents of a sample of about SAMPLE_ROWS hold. They come last in the order of shingles, which
    keeps groups small; any order gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, group in _groups(batch):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(group, width)[0].view(np.int64))], names=["e"])
        give_back()

    sample = df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // SAMPLE_ROWS))) == 0)
    counts = sample.mapInArrow(run, "e long").groupBy("e").count().filter(F.col("count") >= COMMON_IN_SAMPLE)
    return np.sort(np.array([r.e for r in counts.orderBy(F.desc("count"), "e").limit(MOST_COMMON).collect()], U64))


def first_shingles(df: DataFrame, late: np.ndarray, width: int, percent: int, buckets: int) -> DataFrame:
    """bucket, ids, es: of each set the first n - ceil(percent * n / 100) + 1 shingles, ordered by hash, but those in `late` last.
    Two sets that reach the threshold share percent of the larger, so the first that they share is among these. It is also
    among the first n - ceil(2 * percent * n / (100 + percent)) + 1 of the smaller, as they share percent of both but for
    100 + percent. Many shingles make one row for each bucket, which is less to shuffle than rows of their own: an e has 31 bits
    besides its bucket, and in the lowest bit whether it is among these fewer ones."""

    def among(values: np.ndarray) -> np.ndarray:
        return late[np.minimum(np.searchsorted(late, values), len(late) - 1)] == values if len(late) else np.zeros(len(values), bool)

    def dealt(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bucket, ids, es = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        ends = pa.array(np.append(starts, len(order)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (ids, es)]
        return pa.RecordBatch.from_arrays([pa.array(names), *lists], names=["bucket", "ids", "es"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for rows, group in _groups(batch):
                values, offsets = shingle_sets(group, width)
                n = np.diff(offsets)
                of = np.repeat(np.arange(len(n)), n)
                order = np.argsort(2 * of + among(values), kind="stable")  # values are in order within a text
                place = np.arange(len(of)) - offsets[of]
                keep = place < (n + (-percent * n) // 100 + 1)[of]
                inner = (place < (n + (-2 * percent * n) // (100 + percent) + 1)[of])[keep]
                e = mix(values[order][keep])
                es = ((e & U64(0x7FFFFFFF)) << U64(1) | inner.astype(U64)).astype(np.uint32).view(np.int32)
                held.append((((e >> U64(31)) % U64(buckets)).astype(np.int32), rows.column(0).to_numpy()[of[keep]], es))
                size += len(e)
                if size >= FIRSTS_AT_ONCE:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)
        held.clear()
        give_back()

    return df.mapInArrow(run, "bucket int, ids array<long>, es array<int>")


def joins_of_parts(part: np.ndarray, node: np.ndarray, label: np.ndarray, n: np.ndarray, side: np.ndarray, bits: list[bytes], percent: int, items: list[bytes] | None = None) -> list[tuple[int, int]]:
    """A forest of pairs of nodes that have rows of one part and of different labels (and sides, if there are two) whose
    parities let them reach the threshold; with items, that do reach it."""
    out: list[tuple[int, int]] = []
    if not len(part):
        return out
    order = np.lexsort((n, part))
    part, node, label, n, side = part[order], node[order], label[order], n[order], side[order]
    names, at = np.unique(node, return_inverse=True)
    root = np.arange(len(names))
    words = np.array([len(b) // 8 for b in bits])[order]
    # For each width a matrix of all rows at least as wide, folded to it, the widest first.
    wide = np.argsort(-words, kind="stable")
    slot = np.argsort(wide, kind="stable")
    folded, w = {}, int(words.max())
    matrix = np.zeros((0, 2 * w), U64)
    while w >= words.min():
        own = [bits[order[i]] for i in wide[len(matrix) :] if words[i] == w]
        matrix = np.concatenate((matrix[:, :w] ^ matrix[:, w:], np.frombuffer(b"".join(own), U64).reshape(-1, w)))
        folded[w], w = matrix, w // 2
    mixed = len(np.unique(side)) > 1
    i, step = np.arange(len(part)), 0
    while len(i):
        # Rows of a part are in order of size: who is too small for the row `step` on is so for all further ones.
        step += 1
        i = i[i + step < len(part)]
        i = i[(part[i] == part[i + step]) & (n[i + step] * percent <= 100 * n[i])]
        a = i[(label[i] != label[i + step]) & (root[at[i]] != root[at[i + step]])]
        if mixed:
            a = a[side[a] != side[a + step]]
        b = a + step
        least = np.minimum(words[a], words[b])
        for w in np.unique(least):
            x, y = a[least == w], b[least == w]
            apart = np.bitwise_count(folded[w][slot[x]] ^ folded[w][slot[y]]).sum(axis=1, dtype=np.int64)
            near = apart * (100 + percent) <= (100 - percent) * (n[x] + n[y])
            for p, q in zip(x[near], y[near], strict=True):
                low, high = sorted((root[at[p]], root[at[q]]))
                if low == high:
                    continue
                if items is not None:
                    common = len(np.intersect1d(np.frombuffer(items[order[p]], U64), np.frombuffer(items[order[q]], U64), assume_unique=True))
                    if 100 * common < percent * (n[p] + n[q] - common):
                        continue
                out.append((int(names[high]), int(names[low])))
                root[root == high] = low
    return out


def joins_of_tasks(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: what joins_of_parts finds. rows: task, part, node, label, n, side, bits and, to verify, items."""
    verify = "items" in rows.columns

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [pdf[c].to_numpy() for c in ("part", "node", "label", "n", "side")]
        out = joins_of_parts(*columns, list(pdf["bits"]), percent, list(pdf["items"]) if verify else None)
        give_back()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("task").applyInPandas(work, "a long, b long")


def left_apart(texts: DataFrame, sketches: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links between components that bands and estimates passed over. texts: doc_id, t; known: doc_id, label and
    whether its sets count (it leads its class or has several rows), of documents that aren't alone."""
    blobs, shingle, part = _bytes(texts, "doc_id", "t"), Window.partitionBy("e", "bucket"), Window.partitionBy("part")
    rows, shingles = sketches.agg(F.count(F.lit(1)), F.sum("n")).first()
    buckets = 1 + (rows + (shingles or 0) * (100 - percent) // 100) // FIRSTS_IN_BUCKET
    firsts = first_shingles(blobs, common_shingles(blobs, rows, width), width, percent, buckets).repartitionById(buckets, F.col("bucket"))
    firsts = firsts.select("bucket", "es", F.posexplode("ids").alias("i", "id")).select("bucket", "id", F.col("es")[F.col("i")].alias("e"))
    firsts = firsts.select("bucket", "id", F.shiftrightunsigned("e", 1).alias("e"), (F.col("e").bitwiseAND(F.lit(1)) == 1).alias("inner"))
    # Shingles with the same holders make one part; parts that fall together by chance only grow.
    holders = F.bit_xor(F.xxhash64("id")).over(shingle).alias("part")
    ends = [F.min("id").over(shingle).alias("l"), F.max("id").over(shingle).alias("h"), F.max("inner").over(shingle).alias("some")]
    shared = firsts.select("id", "inner", holders, *ends).filter("l < h and some").groupBy("id", "part").agg(F.max("inner").alias("inner"))
    real = sketches.filter("n > 0 and doc_id is not null")
    docs = real.groupBy("doc_id").agg(F.min("n").alias("least"), F.max("n").alias("n")).join(known, "doc_id", "left").filter("leads is null or leads")
    docs = docs.select(F.col("doc_id").alias("id"), F.coalesce("label", "doc_id").alias("label"), "least", "n")
    # Who has no other of about its size in a part, before or after it in order of size, can't reach the threshold there; nor
    # can two of whom the smaller hasn't the shingle among its fewer ones. Of several sets of a document any may be the smaller.
    ends = [F.min("label").over(part).alias("l"), F.max("label").over(part).alias("h")]
    inner, sized = (F.col("inner") | (F.col("least") < F.col("n"))).alias("inner"), part.orderBy("least", "id")
    sizes = [F.max(F.when(F.col("inner"), F.col("n"))).over(sized.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.lead("least").over(sized).alias("after")]
    held = shared.join(docs, "id").select("id", "label", "least", "n", "part", inner).select("*", *ends, *sizes)
    held = held.filter(F.expr(f"l < h and (least * {percent} <= 100 * before or inner and after * {percent} <= 100 * n)"))
    held = materialize(held.select("id", "label", "n", "part"), "apart")

    def joins(seats: DataFrame, sets: DataFrame, node: str) -> DataFrame:
        """seats: id, label, n, part."""
        sized = seats.join(seats.groupBy("part").agg(_chunks()), "part").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        dealt = _across(sized).select("id", F.col(node).alias("node"), "label", "part", "side", "task")
        return materialize(joins_of_tasks(dealt.join(sets, F.col("id") == F.col("doc_id")), percent), "joins")

    near = joins(held, real.select("doc_id", "n", "bits"), "id")
    if not near.isEmpty():
        groups = connected_components(near).select(F.col("node").alias("id"), F.col("component").alias("part"))
        wanted = materialize(groups.join(held.select("id", "label", "n").distinct(), "id"), "candidates")
        found = sketch_documents(texts.join(wanted.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "doc_id", "t", True, width)
        sets = materialize(found.select("doc_id", "n", "bits", "items"), "sets")
        near = joins(wanted, sets, "label")
        discard(sets, wanted)
    discard(held)
    return near


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, slack: float = 0.15) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    drawn = materialize(sketch_documents(df, id_col, text_col, False, width), "drawn")
    led = drawn.filter("n > 0 and doc_id is not null").groupBy("digest", "n").agg(F.min(F.struct("doc_id", "bands")).alias("c"))
    leads = materialize(pod_leads(led.select("n", F.col("c.doc_id").alias("id"), F.col("c.bands").alias("bands"))), "leads")
    # Bands take most of the space, and only classes with company need theirs from here on.
    sketches = materialize(drawn.drop("bands"), "sketches")
    discard(drawn)
    real = sketches.filter("n > 0 and doc_id is not null")
    classes = materialize(real.groupBy("digest", "n").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows")), "classes")

    seats = materialize(pod_seats(leads), "pods")
    # Texts of classes without company stay where they are; the sets of the others are made once. Texts, not sets, which take
    # more, are joined with the seats, so that sets are shuffled once.
    company = seats.select(F.col("id").alias("doc_id")).distinct()
    company = F.broadcast(company) if seats.count() <= IDS_TO_ALL else company
    wanted = _texts(df, id_col, text_col).join(company, "doc_id", "left_semi")
    dealt = _task(seats.withColumn("part", F.col("pod")), "chunk").groupBy("id").agg(F.collect_list(F.struct("task", "part")).alias("at"))
    wanted = wanted.join(dealt, F.col("doc_id") == F.col("id"))
    sets = materialize(sketch_documents(wanted, "doc_id", "t", True, width, ("at",)).drop("bits"), "sets")
    sat = sets.select("doc_id", "n", "regs", "items", F.inline("at"))
    sat = sat.withColumns({"label": F.col("doc_id"), "side": F.lit(0), "band": F.lit(None).cast("int")})
    links = materialize(links_of_tasks(sat, percent, slack), "links")
    components = materialize(connected_components(links), "components")

    rest = materialize(open_seats(leads, seats, components), "open")
    discard(leads)
    met = sets.drop("at").join(_across(rest).select("id", "label", "band", "part", "task", "side"), F.col("doc_id") == F.col("id"))
    joined = connected_components(materialize(links_of_tasks(met, percent, slack), "links")).select(F.col("node").alias("k"), F.col("component").alias("over"))

    discard(sets)
    # Only classes that stand for more than one row or are linked go to the last join.
    first = classes.select("digest", "n", "rows", "id").join(components, F.col("id") == F.col("node"), "left").withColumn("first", F.coalesce("component", "id"))
    named = first.join(joined, F.col("first") == F.col("k"), "left").withColumn("named", F.coalesce("over", "first"))
    named = materialize(named.filter("rows > 1 or component is not null or over is not null").select("digest", "n", "id", F.col("named").alias("component")), "named")

    of = sketches.select("doc_id", "n", "digest").filter("doc_id is not null").join(named, ["digest", "n"])
    several = sketches.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    leads = F.max((F.col("doc_id") == F.col("id")) | F.col("count").isNotNull()).alias("leads")
    known = materialize(of.join(several, "doc_id", "left").groupBy("doc_id").agg(F.min("component").alias("label"), leads), "known")
    links = left_apart(_texts(df, id_col, text_col).filter("doc_id is not null"), sketches, known, width, percent)
    # A document of several rows has the links of all of them.
    links = materialize(links.union(of.join(several, "doc_id", "left_semi").select("doc_id", "component").distinct()), "links")

    out = sketches.select("doc_id", "n", "digest").join(named, ["digest", "n"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    if not links.isEmpty():
        last = connected_components(links).select("node", F.col("component").alias("last"))
        out = out.join(last, F.col("component") == F.col("node"), "left").withColumn("component", F.coalesce("last", "component"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """df with the first document of each group; all columns stay, as do rows with a null identifier."""
    drop = unused(df, "drop")
    dropped = near_duplicates(df, id_col, text_col, width, percent).filter("doc_id is not null and not kept").select(F.col("doc_id").alias(drop)).distinct()
    return df.join(dropped, F.col(id_col).cast("long") == F.col(drop), "left_anti")
