"""Removal of repeated substrings, exact, by threshold-bounded expansion of Burrows-Wheeler intervals.

A byte goes if a string of `length` bytes covers it that also starts in a document with a smaller identifier. Texts are
seen as UTF-8, and matches never cross documents.

Dealing. Every window of `length` bytes has a smallest gram: that with the least hash of the grams of `GRAM` bytes in
it. Equal windows have equal smallest grams, so grams decide where windows meet. Consecutive windows with one smallest
gram make a piece (their joined bytes). Documents stay in blocks of bounded size, in a table bucketed by block, so that
texts move once; equal pieces inside a block count once, for the smallest document of the block that holds them.

1. Blocks send their grams, 32 bits each; where a gram has come from two blocks, the blocks hear that it is shared.
2. Blocks send the pieces of shared grams, and of grams with several pieces in the block. A gram with very many pieces
   is hot: its pieces are cut to single windows and dealt by the window, so that no task holds all of them.
3. Where the pieces of a gram meet, those of equal bytes are merged. All contents of grams that have several, some grams at a
   time, are joined to one text, of which the suffixes are sorted and the Burrows-Wheeler transform is taken. From the empty string on, intervals
   of the transform are extended backward, breadth first, so that common prefixes between neighbouring suffixes are found
   by increasing value; it stops at `length`, and neighbours without a value by then share a window. Blocks hear, for each
   piece, which of its windows a smaller document has.
4. Blocks mark windows, join them to runs, and cut.

Hashes deal and name pieces; where two of one hash meet, their bytes are compared.

Defined results: null and empty texts give zeros and the hash of nothing; texts shorter than `length` lose nothing;
repeats inside one document stay; rows that share an identifier are compared with smaller identifiers only, not with
one another; rows with a null identifier count as larger than all, and not as sources for one another; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.llm.hashing import BYTE_VALUES, U64, mix
from retrospark.llm.workers import give_back
from retrospark.storage import discard, materialize, shared_folder

GRAM = 24
#: Of a piece, at most so many windows: one bit each in a word, with one to spare.
MASK_BITS = 63
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
HOT_PIECES, SEVERAL = 2000, 8
STEP_BYTES = 1 << 17
NO_ID = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Prefix:
    """Hashes of any part of a buffer."""

    def __init__(self, buffer: np.ndarray):
        size = max(STEP_BYTES, 1 << int(len(buffer)).bit_length())
        powers, self.inverse = _powers(size)
        self.sums = np.zeros(len(buffer) + 1, U64)
        np.cumsum(BYTE_VALUES[buffer] * powers[: len(buffer)], out=self.sums[1:])

    def grams(self) -> np.ndarray:
        """A short hash of the gram at each place, good enough to choose the least of some."""
        h = (self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[: len(self.sums) - GRAM]
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(32)
        return h

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start] + np.asarray(size).astype(U64))


class Pieces:
    """The pieces of a block's documents, in order of identifier."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.texts, self.length = ids[order], [texts[i] for i in order], length
        found: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(self.texts):
            end, size = at, 0
            while end < len(self.texts) and (end == at or size + len(self.texts[end]) < STEP_BYTES):
                size += len(self.texts[end])
                end += 1
            found.append(self._cut(at, end))
            at = end
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, U64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3]
        self.gram, self.hash, self.doc, self.start, self.windows = cols
        # Documents are in order, so the first piece of each content is that of the smallest document.
        self.contents, self.first, self.content = np.unique(self.hash, return_index=True, return_inverse=True)
        self._verify()
        self.content_gram = self.gram[self.first]
        self.grams, self.gram_of, self.variety = np.unique(self.content_gram, return_inverse=True, return_counts=True)

    def _cut(self, begin: int, end: int) -> tuple[np.ndarray, ...]:
        length, texts = self.length, self.texts[begin:end]
        sizes = np.array([len(t) for t in texts], np.int64)
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum(sizes) - sizes
        windows = np.maximum(sizes - length + 1, 0)
        total = int(windows.sum())
        if not total:
            return np.zeros(0, U64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3
        part = Prefix(buffer)
        low = part.grams()
        span = length - GRAM + 1
        # The least of `span` neighbours from the least of powers of two.
        step = 1
        while 2 * step <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if span > step:
            low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
        # Where the least changes, and where documents begin and their windows end.
        real = windows > 0
        begins, ends = offsets[real], (offsets + windows)[real]
        new = np.zeros(len(low) + 1, bool)
        new[1:-1] = low[1:] != low[:-1]
        new[begins] = new[ends] = True
        run = np.flatnonzero(new)
        owner = np.searchsorted(begins, run, side="right") - 1
        inside = (owner >= 0) & (run < ends[owner])
        run_size = np.diff(np.append(run, len(low)))[inside]
        run, doc = run[inside], np.flatnonzero(real)[owner[inside]]
        # Runs of more windows than a mask has bits, or than one gram can be the least of (periodic texts), are cut.
        span = min(span, MASK_BITS)
        times = -(-run_size // span)
        if len(run) == times.sum():
            head, count = run, run_size
        else:
            turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            head, count, doc = np.repeat(run, times) + span * turn, np.minimum(span, np.repeat(run_size, times) - span * turn), np.repeat(doc, times)
        return low[head], part(head, count + length - 1), doc + begin, head - offsets[doc], count

    def _verify(self) -> None:
        """Compare the bytes of pieces that share a hash."""
        again = np.flatnonzero(self.first[self.content] != np.arange(len(self.content)))
        model = self.first[self.content[again]]
        if not np.array_equal(self.windows[again], self.windows[model]) or self.bytes_of(again) != self.bytes_of(model):
            raise RuntimeError("two pieces of a block differ and share a hash of 64 bits; choose another block size")

    def bytes_of(self, pieces: np.ndarray) -> list[bytes]:
        return [self.texts[d][s : s + w] for d, s, w in zip(self.doc[pieces].tolist(), self.start[pieces].tolist(), (self.windows[pieces] + self.length - 1).tolist(), strict=True)]

    def hot_windows(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The single windows of pieces with hot grams: their hashes, documents, starts; then the first of each hash, and its inverse."""
        at = np.flatnonzero(np.isin(self.gram, hot))
        doc = np.repeat(self.doc[at], self.windows[at])
        start = np.repeat(self.start[at], self.windows[at]) + np.arange(len(doc)) - np.repeat(np.cumsum(self.windows[at]) - self.windows[at], self.windows[at])
        if not len(doc):
            none = np.zeros(0, np.int64)
            return np.zeros(0, U64), none, none, none, none
        h = np.zeros(len(doc), U64)
        for d in np.unique(doc):
            own = np.flatnonzero(doc == d)
            h[own] = Prefix(np.frombuffer(self.texts[d], np.uint8))(start[own], self.length)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return h, doc, start, first, inverse


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a cyclic text (symbols under 512) sorted by at least `depth` symbols, and each one's place."""
    n, bits, k = len(text), 9, 7
    key, longer = np.zeros(n, np.int64), np.concatenate([text, text[:k]])
    for j in range(k):
        key = (key << bits) | longer[j : j + n]
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    while True:
        # The rank of a suffix is the place where its group begins; only suffixes in groups of several are sorted on.
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(start, size)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if k >= depth or not len(tied):
            break
        own = order[tied]
        after = own + k
        after[after >= n] -= n
        key = rank[own] * n + rank[after]
        sort = np.argsort(key)
        order[tied], key = own[sort], key[sort]
        new[tied[1:]] = key[1:] != key[:-1]
        k *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, place


def common_prefixes(text: np.ndarray, order: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, whether it shares fewer than `length` symbols with the one before it.

    Intervals of suffixes that begin with a string are extended backward by the transform's symbols, all of one string
    length at a time. Where an extended interval ends, the neighbours beyond share just the string's length; if that was
    not known, the interval is extended in turn. Strings are not extended by the separator 0.
    """
    n = len(text)
    before = text[order - 1]  # the transform; position 0 has the last separator before it
    to = place[order - 1]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for value in range(length):
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        symbol = before[at]
        if value:
            real = symbol > 0
            at, owner, symbol = at[real], owner[real], symbol[real]
        if not len(at):
            break
        key = owner * 512 + symbol
        target = to[at]
        sort = np.argsort(target)
        target, key = target[sort], key[sort]
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        begin, end = target[np.append(0, change)], target[np.append(change - 1, len(target) - 1)] + 1
        new = ~known[end]
        known[end[new]] = True
        low, high = begin[new], end[new]
    return known[:n]


def smallest_owner(text: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each place in a text of contents, each followed by a 0, the smallest document of all contents that hold the
    window which begins there. text: symbols from 1; offsets, sizes and docs by content. Other places get any number."""
    order, place = suffix_order(text, length)
    differs = common_prefixes(text, order, place, length)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    window = np.arange(len(text)) - offsets[owner] + length <= sizes[owner]
    doc = np.where(window, docs[owner], NO_ID)[order]
    least = np.minimum.reduceat(doc, np.flatnonzero(differs))
    best = np.empty(len(text), np.int64)
    best[order] = least[np.cumsum(differs) - 1]
    return best


def separated(text: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of a byte buffer as symbols from 1, each followed by a 0; and where they begin."""
    offsets = np.cumsum(sizes + 1) - sizes - 1
    out = np.zeros(int((sizes + 1).sum()), np.int64)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(offsets, sizes) + inside] = text[np.repeat(start, sizes) + inside].astype(np.int64) + 1
    return out, offsets


def same_bytes(text: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether parts of a buffer are equal to others."""
    same = size == other_size
    own = np.flatnonzero(same)
    n = size[own]
    if len(own):
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = text[np.repeat(start[own], n) + at] != text[np.repeat(other[own], n) + at]
        same[own] = np.add.reduceat(differs, np.cumsum(n) - n) == 0
    return same


def smallest_by_window(text: np.ndarray, start: np.ndarray, sizes: np.ndarray, docs: np.ndarray, gram: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """What smallest_owner gives for parts of a buffer, one part of about STEP_BYTES after the other; and where each
    content begins in it. Contents of one gram, which follow one another, stay together."""
    cuts = [0]
    if len(sizes):
        groups = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(sizes))
        filled = np.cumsum(np.add.reduceat(sizes + 1, groups[:-1])) // STEP_BYTES
        cuts = [*groups[:-1][np.append(True, filled[1:] != filled[:-1])].tolist(), len(sizes)]
    best, where, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        joined, offsets = separated(text, start[i:j], sizes[i:j])
        best.append(smallest_owner(joined, offsets, sizes[i:j], docs[i:j], length))
        where.append(offsets + at)
        at += len(joined)
    return np.concatenate(best), np.concatenate(where)


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams >> U64(32)) % U64(buckets)).astype(np.int64)


def _blocks(df: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """block, doc_id, t: a table bucketed by block in the shared folder."""
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("t"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id") == NO_ID, F.xxhash64("t"))), F.lit(blocks)).cast("int"))
    files = max(min(blocks, 4096), int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"retrospark_blocks_{uuid.uuid4().hex}"
    rows.repartition(files, "block").write.format("parquet").bucketBy(files, "block").sortBy("block").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table._scratch, table._name = f"{shared_folder(spark)}/{name}", name
    return table


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_pieces: int = HOT_PIECES, with_text: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks, buckets = int(total // block_bytes) + 1, int(total // bucket_bytes) + 1
    table = _blocks(df, id_col, text_col, blocks)

    def pieces_of(pdf: pd.DataFrame) -> Pieces:
        return Pieces(pdf.doc_id.to_numpy(np.int64), [bytes(t) for t in pdf.t], length)

    def packets(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        return [(int(bucket[i[0]]), i) for i in np.split(order, cut) if len(i)]

    def send_grams(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pieces_of(pdf)
        block, out = int(pdf.block.iloc[0]), []
        for b, i in packets(_bucket(p.grams, buckets)):
            many = np.flatnonzero(p.variety[i] >= SEVERAL)
            out.append((b, block, p.grams[i].astype(np.uint32).tobytes(), many.astype(np.uint32).tobytes(), p.variety[i][many].astype(np.uint32).tobytes()))
        give_back()
        return pd.DataFrame(out, columns=["bucket", "block", "grams", "many", "times"])

    grams = table.groupBy("block").applyInPandas(send_grams, "bucket int, block int, grams binary, many binary, times binary")

    def meet_grams(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(g, np.uint32) for g in pdf.grams]
        values, inverse, seen = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        pieces = seen.astype(np.int64)
        at = np.cumsum([0] + [len(g) for g in each])
        for k, (many, times) in enumerate(zip(pdf.many, pdf.times, strict=True)):
            i = inverse[at[k] + np.frombuffer(many, np.uint32).astype(np.int64)]
            pieces[i] += np.frombuffer(times, np.uint32) - 1
        hot = pieces >= hot_pieces
        out = []
        for k, block in enumerate(pdf.block):
            own = inverse[at[k] : at[k + 1]]
            shared = (seen[own] > 1) | hot[own]
            if shared.any():
                out.append((int(block), int(pdf.bucket.iloc[0]), values[own[shared & ~hot[own]]].tobytes(), values[own[hot[own]]].tobytes()))
        return pd.DataFrame(out, columns=["block", "bucket", "shared", "hot"])

    shared = materialize(grams.groupBy("bucket").applyInPandas(meet_grams, "block int, bucket int, shared binary, hot binary"), "shared-grams")

    def told(p: Pieces, replies: pd.DataFrame, column: str) -> np.ndarray:
        """Which of the block's grams the replies name."""
        keys = [(U64(b) << U64(32)) | np.frombuffer(x, np.uint32).astype(U64) for b, x in zip(replies.bucket, replies[column], strict=True)]
        own = (_bucket(p.grams, buckets).astype(U64) << U64(32)) | (p.grams & U64(0xFFFFFFFF))
        return np.isin(own, np.concatenate([np.zeros(0, U64), *keys]))

    def send_pieces(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(pdf):
            p = pieces_of(pdf)
            block, hot = int(pdf.block.iloc[0]), told(p, replies, "hot")
            chosen = np.flatnonzero(((told(p, replies, "shared") | (p.variety > 1)) & ~hot)[p.gram_of])
            for b, i in packets(_bucket(p.content_gram[chosen], buckets)):
                i = chosen[i]
                f = p.first[i]
                out.append((b, block, p.content_gram[i].tobytes(), p.contents[i].tobytes(), p.ids[p.doc[f]].tobytes(), p.windows[f].astype(np.uint8).tobytes(), b"".join(p.bytes_of(f))))
            h, doc, start, first, _ = p.hot_windows(p.grams[hot])
            for b, i in packets(_bucket(h[first], buckets)):
                f = first[i]
                text = b"".join(p.texts[d][s : s + length] for d, s in zip(doc[f].tolist(), start[f].tolist(), strict=True))
                out.append((b, block, h[f].tobytes(), h[f].tobytes(), p.ids[doc[f]].tobytes(), np.ones(len(f), np.uint8).tobytes(), text))
        give_back()
        return pd.DataFrame(out, columns=["bucket", "block", "grams", "hashes", "docs", "windows", "bytes"])

    pieces = table.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(send_pieces, "bucket int, block int, grams binary, hashes binary, docs binary, windows binary, bytes binary")

    def meet_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda column, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[column]])
        gram, h, docs, windows = join("grams", U64), join("hashes", U64), join("docs", np.int64), join("windows", np.uint8).astype(np.int64)
        size = windows + length - 1
        text = np.frombuffer(b"".join(pdf.bytes), np.uint8)
        end = np.cumsum(size)
        begin = end - size
        order = np.lexsort((docs, h))
        # Entries of one content, by hash and then by bytes: those of a hash that differ stay apart.
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        again = np.flatnonzero(~new)
        new[again] = ~same_bytes(text, begin[order[again]], size[order[again]], begin[order[again - 1]], size[order[again - 1]])
        first = order[new]  # of each content, the entry of the smallest document
        content = np.empty(len(h), np.int64)
        content[order] = np.cumsum(new) - 1
        # Windows of one content have one smallest document. A content that is alone in its gram shares no window with
        # another; the others are put side by side by gram, and a part of whole grams at a time is transformed.
        masks = np.where(docs[first][content] < docs, (U64(1) << windows.astype(U64)) - U64(1), U64(0))
        _, group, variety = np.unique(gram[first], return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(variety[group] > 1)
        mixed = mixed[np.argsort(group[mixed], kind="stable")]
        f = first[mixed]
        best, offsets = smallest_by_window(text, begin[f], size[f], docs[f], gram[f], length)
        where = np.full(len(first), -1, np.int64)
        where[mixed] = offsets
        e = np.flatnonzero(where[content] >= 0)
        if len(e):
            n = windows[e]
            bit = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            smaller = best[np.repeat(where[content[e]], n) + bit] < np.repeat(docs[e], n)
            masks[e] = np.bitwise_or.reduceat(np.where(smaller, U64(1) << bit.astype(U64), U64(0)), np.cumsum(n) - n)
        out, at = [], 0
        for block, x in zip(pdf.block, pdf.hashes, strict=True):
            n = len(x) // 8
            keep = masks[at : at + n] > 0
            if keep.any():
                out.append((int(block), h[at : at + n][keep].tobytes(), masks[at : at + n][keep].tobytes()))
            at += n
        give_back()
        return pd.DataFrame(out, columns=["block", "hashes", "masks"])

    masks = pieces.groupBy("bucket").applyInPandas(meet_pieces, "block int, hashes binary, masks binary")
    nothing = F.lit(None).cast("binary")
    replies = masks.select("block", F.lit(0).alias("bucket"), "hashes", "masks", nothing.alias("hot")).union(shared.filter(F.octet_length("hot") > 0).select("block", "bucket", nothing.alias("hashes"), nothing.alias("masks"), "hot"))

    def cut(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        if not len(pdf):
            return pd.DataFrame([], columns=columns)
        p = pieces_of(pdf)
        marks = replies[replies.hashes.notna()]
        h = np.concatenate([np.zeros(0, U64), *[np.frombuffer(x, U64) for x in marks.hashes]])
        m = np.concatenate([np.zeros(0, U64), *[np.frombuffer(x, U64) for x in marks["masks"]]])
        order = np.argsort(h, kind="stable")
        h, m = h[order], m[order]

        def mask_of(x: np.ndarray) -> np.ndarray:
            i = np.minimum(np.searchsorted(h, x), max(0, len(h) - 1))
            return np.where(h[i] == x, m[i], U64(0)) if len(h) else np.zeros(len(x), U64)

        hot = np.isin(p.gram, p.grams[told(p, replies[replies.hot.notna()], "hot")]) if len(p.grams) else np.zeros(0, bool)
        later = p.ids[p.doc] > p.ids[p.doc[p.first]][p.content] if len(p.doc) else np.zeros(0, bool)
        every = (U64(1) << p.windows.astype(U64)) - U64(1)
        bits = np.where(hot, U64(0), np.where(later, every, mask_of(p.contents)[p.content] if len(p.doc) else every))
        doc, start = [], []
        touched = np.flatnonzero(bits)
        for k in range(min(length - GRAM + 1, MASK_BITS)):
            on = touched[(bits[touched] >> U64(k)) & U64(1) > 0]
            doc.append(p.doc[on])
            start.append(p.start[on] + k)
        wh, wd, ws, first, inverse = p.hot_windows(np.unique(p.gram[hot]))
        if len(wh):
            on = (p.ids[wd] > p.ids[wd[first]][inverse]) | (mask_of(wh) > 0)
            doc.append(wd[on])
            start.append(ws[on])
        doc, start = np.concatenate(doc), np.concatenate(start)
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        cuts = np.searchsorted(doc, np.arange(len(p.texts) + 1))
        out = []
        for i, t in enumerate(p.texts):
            own = start[cuts[i] : cuts[i + 1]]
            kept, n_spans = t, 0
            if len(own):
                edge = np.zeros(len(t) + 1, np.int32)
                np.add.at(edge, own, 1)
                np.add.at(edge, own + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            row = (None if p.ids[i] == NO_ID else int(p.ids[i]), len(t), len(t) - len(kept), n_spans, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept) if with_text else row)
        give_back()
        return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    out = materialize(table.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(cut, schema), "kept")
    df.sparkSession.sql(f"DROP TABLE {table._name}")
    discard(table, shared)
    return out
