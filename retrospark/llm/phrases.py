"""Phrase collocation mining by hierarchical pair naming.

Texts are lower-cased (A-Z), cut at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words `[^\\x20\\x09]+`. A phrase of k
words is the pair of its first and its last k - 1 words, and has a number if it occurs `min_count` times in its language:
words are numbered first; then, level by level, neighbouring numbers in the texts are counted as pairs, frequent pairs are
numbered, and the texts are rewritten as sequences of these. As no phrase is more frequent than its parts,
nothing is lost. A number's pair points at its parents, so the counts on both sides of every cut, and the longer phrases
that hold a phrase, are found by joins of the tables of names, never by looking at texts again.

Texts are handled in pieces of about BLOCK_BYTES, and BLOCK_PIECES of them are a block. A block sends each of its distinct
pairs once, with its count, and Spark sums them; nothing else of it moves, as a pair's number follows from its parts'
numbers: a word's is its place among the hashes of frequent words, which tasks hold; a pair of words' is both in one
long; and that of a longer phrase is a hash of both. Where a level is named by hashes, counts are summed by hash with the
least and the greatest left part, which tell whether two pairs share one; then the level is counted again with another seed.
Where frequent words are more than HELD_WORDS or two words share a hash, blocks ask for their words' numbers by a join, and
pairs of words are named by hashes too.

Pairs that may be frequent, and have a neighbour that may be so too, are known from a bitmap of FILTER_BITS bits over the
frequent pairs' hashes, whose size is fixed; hits by chance cost rows of the next count and change nothing, as what holds a
rare phrase is rare. Sequences keep a block's own small numbers, and only where two neighbours are numbered. Words are
compared by their bytes where their hashes are equal. Ranks come from a range partitioning and one count for each partition
and language, so that a language with most of the phrases is dealt to many tasks.

Counts are longs; scores and shares are compared as decimals, exactly.

Defined results: null texts are empty and give nothing; null languages are `und`, together with those named so. Repeated
rows count each. An empty table, or one without frequent phrases, gives no rows. A piece without a break may be as long as
a text; other texts are cut between pieces where they exceed a block. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrospark.llm.hashing import hashes_of, mix, word_slices
from retrospark.llm.workers import give_back
from retrospark.storage import discard, materialize

MIN_COUNT, LONGEST, TOP, SUBSUMED = 30, 4, 2000, 80
BLOCK_BYTES, BLOCK_PIECES, COUNTED_PIECES, FILTER_BITS, SENT_ROWS = 1 << 20, 8, 8, 1 << 25, 1 << 15
#: Frequent words whose hashes each task holds at most: 32 MB.
HELD_WORDS = 1 << 22
U64 = np.uint64
# Bytes: 0 of words, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NO_BYTES = np.zeros(0, np.uint8)


# --- words of a block -------------------------------------------------------------------------------------------------


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(bytes, each text followed by a piece's end; the language of each byte's text by its end; languages) of about BLOCK_BYTES.

    batches: lang string, text binary; no nulls.
    """
    parts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8) if text.as_buffer().size else _NO_BYTES
            while len(data):
                cut = len(data)
                if cut > BLOCK_BYTES:  # at the first end of a piece after a block's size
                    cut = next((at + i + 1 for at in range(BLOCK_BYTES, cut, BLOCK_BYTES) for i in np.flatnonzero(_KIND[data[at : at + BLOCK_BYTES]] == 2)[:1].tolist()), cut)
                parts += [data[:cut], np.array([10], np.uint8)]
                langs.append(lang)
                size, data = size + cut + 1, data[cut:]
                if size >= BLOCK_BYTES:
                    yield _piece(parts, langs)
                    parts, langs, size = [], [], 0
    if parts:
        yield _piece(parts, langs)


def _piece(parts: list[np.ndarray], langs: list[str]):
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    ends = np.cumsum([len(parts[i]) + 1 for i in range(0, len(parts), 2)])
    return np.concatenate(parts), np.stack([ends, [number[x] for x in langs]], 1), names


def words_of(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts and ends of words; each word's language; and whether the word before is in its piece."""
    low = _LOWER[data]
    kind = _KIND[low]
    edge = np.diff(np.concatenate(([0], (kind == 0).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    follows = np.concatenate(([False], piece[1:] == piece[:-1]))[: len(starts)]
    lang = texts[np.searchsorted(texts[:, 0], starts, "right"), 1] if len(starts) else np.zeros(0, np.int64)
    return low, starts, ends, lang, follows


@lru_cache(maxsize=1 << 16)
def _lang_seed(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _lang_seeds(names: list[str]) -> np.ndarray:
    return np.array([_lang_seed(x) for x in names], U64)


def _bytes_of(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all bytes of words that start there and are that long."""
    return np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)


def distinct_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct (language, word) one place where it stands, each word's number among them, and the counts."""
    _, first, number, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    size, like = ends - starts, first[number]
    same = bool((size == size[like]).all() and (lang == lang[like]).all())
    for i, j in word_slices(starts) if same else ():
        same = same and bool((low[_bytes_of(starts[i:j], size[i:j])] == low[_bytes_of(starts[like[i:j]], size[i:j])]).all())
    if not same:  # two words of one hash: count them by their bytes
        seen: dict[tuple[int, bytes], int] = {}
        number = np.array([seen.setdefault((g, low[s:e].tobytes()), len(seen)) for g, s, e in zip(lang.tolist(), starts, ends, strict=True)], np.int64)
        _, first, count = np.unique(number, return_index=True, return_counts=True)
    return first, number, count


def _word_arrays(low, starts, ends, lang, names, chosen) -> tuple[pa.Array, pa.Array]:
    """Languages and bytes of the chosen words."""
    s, e = starts[chosen], ends[chosen]
    size = e - s
    at = _bytes_of(s, size)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(low[at]))])
    langs = pa.DictionaryArray.from_arrays(pa.array(lang[chosen].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
    return langs, words


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, hash, n: a row for each distinct word of some pieces."""
    for pieces in _grouped(map(_counted, text_blocks(batches)), COUNTED_PIECES):
        yield from _added_up(pieces).to_batches(max_chunksize=SENT_ROWS)
        give_back()
    give_back()


def _added_up(rows: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(rows).group_by(["lang", "word", "hash"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["lang", "word", "hash", "n"])


def _counted(piece: tuple) -> pa.RecordBatch:
    data, texts, names = piece
    low, starts, ends, lang, _ = words_of(data, texts)
    hashes = hashes_of(low, starts, ends, _lang_seeds(names)[lang])
    first, _, count = distinct_words(low, starts, ends, lang, hashes)
    columns = [*_word_arrays(low, starts, ends, lang, names, first), pa.array(hashes[first].view(np.int64)), pa.array(count.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "hash", "n"])


def _grouped(items: Iterator, n: int) -> Iterator[list]:
    while group := list(itertools.islice(items, n)):
        yield group


# --- bitmaps ----------------------------------------------------------------------------------------------------------


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left.astype(U64)) * U64(3) + right.astype(U64))


def _table_hashes(batch: pa.RecordBatch) -> np.ndarray:
    if batch.schema.names == ["left", "right"]:
        return pair_hashes(batch.column(0).to_numpy(), batch.column(1).to_numpy())
    langs, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return hashes_of(data, starts, ends, _lang_seeds(langs))


def bitmap(keys: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, as longs, of the keys' hashes; keys: (left, right) or (lang, word). The driver gets no more than these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            if b.num_rows:
                bits[_table_hashes(b) % U64(FILTER_BITS)] = True
        longs = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(longs)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(longs[at])], names=["slot", "bits"])

    out = np.zeros(FILTER_BITS // 64, np.int64)
    found = keys.mapInArrow(run, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return out


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % U64(FILTER_BITS)
    return (bits.view(U64)[at >> U64(6)] >> (at & U64(63)) & U64(1)).astype(bool)


# --- sequences --------------------------------------------------------------------------------------------------------


def compact(codes: np.ndarray) -> np.ndarray:
    """The sequence without numbers that have no numbered neighbour, and with one 0 for each gap."""
    some = codes != 0
    near = np.zeros(len(codes), bool)
    near[1:] |= some[:-1]
    near[:-1] |= some[1:]
    codes = np.where(near, codes, 0)
    return codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))[: len(codes)]]


def _packed(codes: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(codes.max(initial=0)))
    return bytes([kind.itemsize]) + codes.astype(kind).tobytes()


def _unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    data = memoryview(data)
    return np.frombuffer(data, f"u{data.cast('B')[0]}", offset=1)


def _pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where two numbers stand side by side, and the two in one."""
    at = np.flatnonzero((codes[:-1] != 0) & (codes[1:] != 0))
    return at, codes[at].astype(np.int64) << 32 | codes[at + 1].astype(np.int64)


def named_words(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """block, codes (a sequence for each piece), ids (of the numbers from 1), and the block's words by language. known: the
    frequent words' hashes, rising; a word's id is its place among them."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for block, pieces in enumerate(_grouped(_known_words(text_blocks(batches), shared.value), BLOCK_PIECES)):
            ids = np.unique(np.concatenate([own for _, own, _ in pieces]))
            codes = (np.concatenate(([0], np.searchsorted(ids, own) + 1))[_unpacked(c)] for c, own, _ in pieces)
            b = _block(task | block, codes, ids)
            total = Counter()
            for p in pieces:
                total.update(p[2])
            sizes = pa.array([[{"lang": x, "n": c} for x, c in total.items()]], pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*b.columns, sizes], names=["block", "codes", "ids", "sizes"])
        give_back()

    return docs.mapInArrow(run, "block long, codes array<binary>, ids array<long>, sizes array<struct<lang:string,n:long>>")


def _spread(codes: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """The words' numbers with a 0 before each word that starts a piece of text, made compact."""
    spread = np.zeros(len(codes) + (~follows).sum(), np.int64)
    spread[np.arange(len(codes)) + np.cumsum(~follows)] = codes
    return compact(spread)


def _known_words(pieces: Iterator, known: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, Counter]]:
    """For each piece its sequence, the ids of the words numbered in it, and its words by language."""
    for data, texts, names in pieces:
        low, starts, ends, lang, follows = words_of(data, texts)
        hashes = hashes_of(low, starts, ends, _lang_seeds(names)[lang])
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        spread = _spread(np.where(known[at] == hashes, at + 1, 0), follows)
        used = np.unique(spread[spread != 0])
        total = Counter(dict(zip(names, np.bincount(lang, minlength=len(names)).tolist(), strict=True)))
        yield _packed(np.where(spread != 0, np.searchsorted(used, spread) + 1, 0)), used - 1, total


def word_sequences(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """block, codes (a sequence for each piece), words (of the numbers from 1), and the block's words by language."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for block, pieces in enumerate(_grouped(_likely_words(text_blocks(batches), shared.value), BLOCK_PIECES)):
            # The pieces' words as one text: each distinct word once.
            names = sorted({x for p in pieces for x in p[3]})
            langs = pa.concat_arrays([p[1] for p in pieces])
            words = pa.concat_arrays([p[2] for p in pieces])
            ends = np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)
            starts = np.concatenate(([0], ends[:-1]))[: len(ends)]
            data = np.frombuffer(words.buffers()[2], np.uint8) if len(ends) else _NO_BYTES
            of = pc.index_in(langs, pa.array(names, pa.string())).to_numpy() if len(langs) else np.zeros(0, np.int32)
            first, number, _ = distinct_words(data, starts, ends, of, hashes_of(data, starts, ends, _lang_seeds(names)[of]))
            cuts = np.cumsum([0, *(len(p[1]) for p in pieces)])
            codes = [_packed(np.concatenate(([0], number[i:j] + 1))[_unpacked(p[0])]) for p, i, j in zip(pieces, cuts, cuts[1:], strict=False)]
            whole = pa.StructArray.from_arrays([langs.take(pa.array(first)), words.take(pa.array(first))], ["lang", "word"])
            total = Counter()
            for p in pieces:
                total.update(p[3])
            sizes = [{"lang": x, "n": c} for x, c in total.items()]
            kinds = (pa.int64(), pa.list_(pa.binary()), None, pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))
            columns = [pa.array([task | block], kinds[0]), pa.array([codes], kinds[1]), pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), pa.array([sizes], kinds[3])]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "codes", "words", "sizes"])
        give_back()

    return docs.mapInArrow(run, "block long, codes array<binary>, words array<struct<lang:string,word:binary>>, sizes array<struct<lang:string,n:long>>")


def _likely_words(pieces: Iterator, bits: np.ndarray) -> Iterator[tuple[bytes, pa.Array, pa.Array, Counter]]:
    """For each piece its sequence, the languages and bytes of the words numbered in it, and its words by language."""
    for data, texts, names in pieces:
        low, starts, ends, lang, follows = words_of(data, texts)
        hashes = hashes_of(low, starts, ends, _lang_seeds(names)[lang])
        some = np.flatnonzero(may_hold(bits, hashes))
        first, number, _ = distinct_words(low, starts[some], ends[some], lang[some], hashes[some])
        codes = np.zeros(len(starts), np.int64)
        codes[some] = number + 1
        spread = _spread(codes, follows)
        used = np.unique(spread[spread != 0])
        renumber = np.zeros(len(first) + 1, np.int64)
        renumber[used] = np.arange(1, len(used) + 1)
        total = Counter(dict(zip(names, np.bincount(lang, minlength=len(names)).tolist(), strict=True)))
        yield _packed(renumber[spread]), *_word_arrays(low, starts, ends, lang, names, some[first[used - 1]]), total


def _lists(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of (block, codes, arrays ...): block, its sequences, and the arrays."""
    for block, codes, *arrays in zip(*b.columns, strict=True):
        yield block.as_py(), [_unpacked(c.as_buffer()) for c in codes.values], *(x.values for x in arrays)


def _block(block: int, codes: Iterator[np.ndarray], ids: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([block], pa.int64()), pa.array([[_packed(compact(c)) for c in codes]], pa.list_(pa.binary())), pa.array([ids], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "codes", "ids"])


def numbered_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, codes, found (i, id) -> block, codes, ids: numbers from 1 in order of the ids."""
    for b in batches:
        for block, codes, found in _lists(b):
            at, ids = (x.to_numpy() for x in found.flatten())
            order = np.argsort(ids)
            new = np.zeros(1 + max(int(at.max(initial=-1)) + 1, *(int(c.max(initial=0)) for c in codes)), np.int64)
            new[at[order] + 1] = np.arange(1, len(ids) + 1)
            yield _block(block, (new[c] for c in codes), ids[order])
    give_back()


def count_pairs(blocks: DataFrame, seed: int | None = None) -> DataFrame:
    """left, right, n: a row for each distinct pair of some pieces; with a seed, id (by hash), left, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, codes, ids in _lists(b):
                for pieces in _grouped(iter(codes), COUNTED_PIECES):
                    # Sorted in place, so that little more than the pairs is held.
                    pairs = np.concatenate([_pairs(c)[1] for c in pieces])
                    pairs.sort()
                    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))[: len(pairs)])
                    n = np.diff(np.append(first, len(pairs)))
                    pairs = pairs[first]
                    for i in range(0, len(pairs), SENT_ROWS):
                        left, right = _of_pairs(ids.to_numpy(), pairs[i : i + SENT_ROWS])
                        key = [left, right] if seed is None else [hashed_names(left, right, seed), left]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, key), pa.array(n[i : i + SENT_ROWS].astype(np.int64))], names=names)
                give_back()
        give_back()

    names = ["left", "right", "n"] if seed is None else ["id", "left", "n"]
    return blocks.select("block", "codes", "ids").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _of_pairs(ids: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[(pairs >> 32) - 1], ids[(pairs & 0xFFFFFFFF) - 1]


def packed_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of pairs of words, whose ids are under HELD_WORDS: both in one long."""
    return left << 32 | right


def _seeded(left: np.ndarray, seed: int) -> np.ndarray:
    return mix(left.view(U64) ^ mix(np.array([seed], U64))) * U64(3)


def hashed_names(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    """Numbers of pairs by hash; of those with one number, no two have the same left part."""
    return (_seeded(left, seed) + right.view(U64)).view(np.int64)


def right_of(name: np.ndarray, left: np.ndarray, seed: int) -> np.ndarray:
    """The right part of a pair that hashed_names() has named."""
    return (name.view(U64) - _seeded(left, seed)).view(np.int64)


def named_pairs(blocks: DataFrame, bits: np.ndarray, name: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """block, codes, ids of the pairs that the bitmap holds, and that have a neighbour which it holds."""
    shared = blocks.sparkSession.sparkContext.broadcast(bits)

    def likely(c: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at, pairs = _pairs(c)
        some = may_hold(shared.value, pair_hashes(*_of_pairs(ids, pairs)))
        there = np.zeros(len(c) + 1, bool)
        there[at[some]] = True
        return np.unique(pairs[some & (there[at - 1] | there[at + 1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, codes, ids in _lists(b):
                ids = ids.to_numpy()
                keys = np.unique(np.concatenate([likely(c, ids) for c in codes]))
                if not len(keys):
                    continue
                new, rank = np.unique(name(*_of_pairs(ids, keys)), return_inverse=True)

                def named(c: np.ndarray, keys=keys, rank=rank) -> np.ndarray:
                    at, pairs = _pairs(c)
                    where = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    numbers = np.zeros(len(c), np.int64)
                    numbers[at] = np.where(keys[where] == pairs, rank[where] + 1, 0)
                    return numbers

                yield _block(block, map(named, codes), new)
                give_back()
        give_back()

    return blocks.select("block", "codes", "ids").mapInArrow(run, "block long, codes array<binary>, ids array<long>")


# --- names ------------------------------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, min_count: int) -> tuple[DataFrame, np.ndarray | None]:
    """(lang, word, a and id of what occurs often enough; the frequent words' hashes in order of the ids, or None where
    they are too many to be held, or two words share one)."""
    counts = docs.mapInArrow(count_words, "lang string, word binary, hash long, n long")
    # Dealt by hash, so that words that share one meet.
    each = counts.repartition("hash").groupBy("hash", "lang", "word").agg(F.sum("n").alias("a"))
    each = each.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("hash")))
    found = materialize(each.filter((F.col("a") >= min_count) | (F.col("kinds") > 1)).withColumn("id", F.monotonically_increasing_id()), "words")
    n, kinds = found.agg(F.count(F.lit(1)), F.max("kinds")).first()
    if n > HELD_WORDS or (kinds or 0) > 1:
        return found.filter(F.col("a") >= min_count).select("lang", "word", "a", "id"), None
    known = np.sort(found.select("hash").toArrow()["hash"].to_numpy().view(U64))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.searchsorted(shared.value, b.column(3).to_numpy().view(U64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids)], names=["lang", "word", "a", "id"])

    words = materialize(found.select("lang", "word", "a", "hash").mapInArrow(placed, "lang string, word binary, a long, id long"), "words")
    discard(found)
    return words, known


def frequent_pairs(blocks: DataFrame, min_count: int, name: str, id: Column | None = None) -> DataFrame:
    """left, right, a and id of the pairs that occur often enough. Written once, so that all see one id."""
    often = count_pairs(blocks).groupBy("left", "right").agg(F.sum("n").alias("a")).filter(F.col("a") >= min_count)
    return materialize(often.withColumn("id", F.monotonically_increasing_id() if id is None else id), name)


def frequent_hashed(blocks: DataFrame, min_count: int, name: str) -> tuple[DataFrame, int]:
    """(left, right, a and id of the pairs that occur often enough, by hash; its seed). No two pairs have one hash."""
    for seed in itertools.count():

        def parts(batches: Iterator[pa.RecordBatch], seed=seed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                right = right_of(b.column(0).to_numpy(), b.column(1).to_numpy(), seed)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(right), *b.columns[2:], b.column(0)], names=["left", "right", "a", "single", "id"])

        by_hash = count_pairs(blocks, seed).groupBy("id").agg(F.min("left").alias("left"), F.sum("n").alias("a"), F.max("left").alias("most"))
        kept = by_hash.select("id", "left", "a", (F.col("left") == F.col("most")).alias("single")).filter((F.col("a") >= min_count) | ~F.col("single"))
        found = materialize(kept.mapInArrow(parts, "left long, right long, a long, single boolean, id long"), name)
        if found.filter(~F.col("single")).limit(1).count() == 0:
            return found.drop("single"), seed
        discard(found)


def name_levels(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables of names: words (lang, word, a, id), then pairs (left, right, a, id) of each level; and lang, n.

    docs: lang, text (binary).
    """
    words, known = frequent_words(docs, min_count)
    if known is not None and len(known):
        texts = materialize(named_words(docs, known), "blocks")
        blocks = texts
    else:
        texts = materialize(word_sequences(docs, bitmap(words.select("lang", "word"))), "sequences")
        asked = texts.select("block", F.posexplode("words").alias("i", "w")).select("block", "i", F.col("w.lang").alias("lang"), F.col("w.word").alias("word"))
        found = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("i", "id")).alias("found"))
        kind = "block long, codes array<binary>, ids array<long>"
        blocks = materialize(texts.select("block", "codes").join(found, "block").select("block", "codes", "found").mapInArrow(numbered_words, kind), "blocks")
    total = materialize(texts.select(F.explode("sizes").alias("s")).groupBy(F.col("s.lang").alias("lang")).agg(F.sum("s.n").alias("n")), "totals")
    if texts is not blocks:
        discard(texts)
    levels = [words]
    for k in range(2, longest + 1):
        title, name = f"phrases-{k}", packed_names
        if k == longest:  # is never named in texts
            levels.append(frequent_pairs(blocks, min_count, title))
            break
        if k == 2 and known is not None:
            levels.append(frequent_pairs(blocks, min_count, title, F.shiftleft("left", 32).bitwiseOR(F.col("right"))))
        else:
            pairs, seed = frequent_hashed(blocks, min_count, title)
            levels.append(pairs)
            name = partial(hashed_names, seed=seed)
        after = materialize(named_pairs(blocks, bitmap(levels[-1].select("left", "right")), name), "blocks")
        discard(blocks)
        blocks = after
    discard(blocks)
    return levels, total


def with_cuts(levels: list[DataFrame]) -> list[DataFrame]:
    """For each level from 2: id, left, right, lang, phrase, a, and cuts: l and r by place, from the parents' counts.

    Of a phrase of k words, prefix[j] and suffix[j] are the counts of its first and last j words, up to k - 1.
    """
    one = F.array(F.col("a"))
    below = levels[0].select("id", "lang", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), "a", one.alias("prefix"), one.alias("suffix"))
    out = []
    for pairs in levels[1:]:
        x = below.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), "prefix")
        y = below.select(F.col("id").alias("right"), "last", "suffix")
        joined = pairs.join(x, "left").join(y, "right")
        # prefix and suffix of the parents end with the parents' own counts; the cut after k words is prefix[k] and suffix[-k].
        cuts = F.zip_with("prefix", F.reverse("suffix"), lambda l, r: F.struct(l.alias("l"), r.alias("r")))
        this = joined.select("id", "left", "right", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", cuts.alias("cuts"), "prefix", "suffix")
        this = materialize(this, "cuts")
        out.append(this)
        below = this.select("id", "lang", "phrase", "last", "a", F.concat("prefix", one).alias("prefix"), F.concat("suffix", one).alias("suffix"))
    return out


def scored(levels: list[DataFrame], total: DataFrame, subsumed: int = SUBSUMED) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that no longer one holds with `subsumed` % of their occurrences."""
    big = lambda c: c.cast("decimal(20,0)")
    tables, kept = with_cuts(levels), []
    for i, table in enumerate(tables):
        if i + 1 < len(tables):
            # Of all longer phrases that hold this one, the most frequent is one word longer.
            longer = tables[i + 1].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("b")).groupBy("id").agg(F.max("b").alias("b"))
            table = table.join(longer, "id", "left").filter(F.col("b").isNull() | (100 * big(F.col("b")) < subsumed * big(F.col("a"))))
        kept.append(table.select("lang", "phrase", "a", "cuts"))
    rows = kept[0]
    for table in kept[1:]:
        rows = rows.unionByName(table)
    lowest = F.expr("array_min(transform(cuts, (c, i) -> struct((2000000BD * a) div (c.l + c.r) as score, i as k, c.l as l, c.r as r)))")
    rows = rows.select("lang", "phrase", "a", lowest.alias("cut")).join(total, "lang")
    return rows.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, subsumed: int = SUBSUMED) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all phrases of 2 to `longest` words that aren't subsumed by a longer one."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return scored(*name_levels(slim, min_count, longest), subsumed)


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each language by score, a (both falling) and phrase, with their rank."""
    order = ("lang", F.desc("score"), F.desc("a"), "phrase")
    found = materialize(found, "scored")
    parts = found.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = found.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("part", F.shiftright("at", 33)), "placed")
    # Each language's first place in each partition, and its rows in partitions before: a row for each of both.
    w = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("lang", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    ranked = placed.join(firsts, ["lang", "part"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before") + 1)
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
