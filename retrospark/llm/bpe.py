"""SentencePiece BPE: exact merge-type encoding by backtracking, decoding, and token counts by a two-tier lookup.

Model files are read as they are (protocol buffers, of which only the pieces matter); texts are encoded with a leading
space and without normalisation, which is what models with the identity normaliser ask for.

Encoding. Text is cut before each run of spaces and between letters and other characters: no piece of the model holds
a space after another character or a letter beside a non-letter (checked on loading), so no merge crosses such a cut. Inside a part, an Aho-Corasick automaton lists all pieces at all positions. From the left, the longest
piece is tried first; it may stand beside its left neighbour only if merging their characters anew, best merge first,
gives back just these two pieces. Where no piece fits, the position is marked as failed in a bit field and the last
piece is shortened. The first sequence that reaches the end is the one that merging gives, as all its neighbours are
compatible. Characters outside the vocabulary become byte pieces and no merge crosses them.

Decoding turns ids into the bytes of their pieces with one table look-up for all of a text, drops control pieces and
the one leading space, and replaces malformed byte runs.

Token counts. Tier one is a compact table that goes to all tasks by broadcast: the lengths, in tokens, of the most
frequent parts, counted on a bounded sample drawn over all documents (it only saves time: a part gives the same count from
either tier). Tier two is a bounded cache in each worker, filled by encoding the parts that tier one misses. Parts never leave
the task that reads them.

Defined results: null and empty texts have no tokens but the begin and end ids where asked for; repeated rows give
repeated results; an empty table gives an empty table; very long texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.llm.workers import give_back

SPACE = "▁"
PART = re.compile(rf"{SPACE}*[^\W\d_²³¹]+|{SPACE}*(?:[^\w{SPACE}]+|[\d_²³¹]+)+|{SPACE}+")
#: Parts of more characters are encoded without being kept; a worker's cache holds so many bytes, about.
LONG_PART, CACHE_BYTES = 48, 64 << 20
#: Of an entry, besides its characters and ids: two objects and their place in the table.
ENTRY_BYTES = 200
INF = float("inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id. Models that this encoder isn't made for are refused: those that normalise characters
    or drop spaces, those that don't put a space first, other types than merges, and pieces that users defined."""
    out = []
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a merge-type model")
            if number == 3:
                normaliser = dict(_fields(value))
                if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
                    raise ValueError("the model normalises texts")
            if number == 1:
                piece = dict(_fields(value))
                out.append((piece[1].decode(), float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]), piece.get(3, NORMAL)))
    return out


class Encoder:
    """An encoder and decoder for one model file."""

    def __init__(self, path: str):
        import ahocorasick

        pieces = read_pieces(path)
        if any(kind == USER for _, _, kind in pieces):
            raise ValueError("the model has pieces that users defined")
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.rank = {p: -pieces[i][1] for p, i in self.ids.items()}
        self.control = {kind_piece: i for i, (kind_piece, _, kind) in enumerate(pieces) if kind in (CONTROL, UNKNOWN)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.bos, self.eos = self.control["<s>"], self.control["</s>"]
        self.known = {p for p in self.ids if len(p) == 1}
        if any(PART.findall(p) != [p] for p in self.ids):
            raise ValueError("a piece crosses the places where texts are cut")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:  # a character is there without a search
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.spines: tuple[dict[str, list[tuple[str, float]] | None], ...] = ({}, {})
        # Parts by age: where the recent ones fill half the cache, they become the older ones, of which those that come
        # again are recent anew, and the rest are dropped the next time.
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size

    def merge(self, text: str) -> list[str]:
        """Pieces by merging: again and again, the best pair of neighbours, the leftmost of equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = self.rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _spine(self, piece: str, side: int) -> list[tuple[str, float]] | None:
        """The parts that stand at a piece's left (0) or right (1) end while it is merged, smallest first, each with
        the rank of the merge that ends it; None if merging doesn't give the piece."""
        known = self.spines[side]
        if piece not in known:
            symbols, out = list(piece), []
            while len(symbols) > 1:
                rank, i = min((self.rank.get(symbols[i] + symbols[i + 1], INF), i) for i in range(len(symbols) - 1))
                if rank == INF:
                    break
                if i == (len(symbols) - 2) * side:
                    out.append((symbols[-side], rank))
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            known[piece] = None if len(symbols) > 1 else [*out, (piece, INF)]
        return known[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both anew keeps the two apart.

        Both sides merge as if alone until a merge across the border has its turn; that comes if it ranks before the
        next merge of either part at the border. Of equal merges, the left one has its turn first.
        """
        left_known, right_known = self.spines[1], self.spines[0]
        begins = right_known[right] if right in right_known else self._spine(right, 0)
        ends = None if not left else left_known[left] if left in left_known else self._spine(left, 1)
        if not left or ends is None or begins is None:
            return begins is not None
        i = j = 0
        rank = self.rank
        while True:
            part, until = ends[i]
            other, other_until = begins[j]
            across = rank.get(part + other)
            if across is not None and across < until and across <= other_until:
                return False
            if until <= other_until:
                if until == INF:
                    return True
                i += 1
            else:
                j += 1

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text of known characters only."""
        if text in self.ids and self.compatible("", text):
            return [text]
        n = len(text)
        at: list[list[str]] = [[c] for c in text]
        for end, piece in self.automaton.iter(text):
            at[end + 1 - len(piece)].append(piece)  # by increasing length, as ends increase
        out: list[str] = []
        choice: list[int] = []
        failed, pos, k, last, compatible = bytearray(n // 8 + 1), 0, len(at[0]) - 1, "", self.compatible
        while pos < n:
            here = at[pos]
            while k >= 0:
                piece = here[k]
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and compatible(last, piece):
                    break
                k -= 1
            if k >= 0:
                out.append(piece)
                choice.append(k)
                pos, last = end, piece
                k = len(at[pos]) - 1 if pos < n else 0
            else:
                if not out:
                    raise ValueError("no sequence of pieces")
                failed[pos >> 3] |= 1 << (pos & 7)
                pos -= len(out.pop())
                last = out[-1] if out else ""
                k = choice.pop() - 1
        return out

    def encode_part(self, part: str) -> bytes:
        """Ids, little-endian 32-bit, of a part that begins with its spaces."""
        if self.known.issuperset(part):
            return array("I", [self.ids[p] for p in self.backtrack(part)]).tobytes()
        ids: list[int] = []
        begin = 0
        for i, c in enumerate(part):
            if c not in self.known:
                if i > begin:
                    ids += [self.ids[p] for p in self.backtrack(part[begin:i])]
                ids += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
                begin = i + 1
        if begin < len(part):
            ids += [self.ids[p] for p in self.backtrack(part[begin:])]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids, little-endian 32-bit, without begin and end."""
        if not text:
            return b""
        parts, out = self.parts, []
        for part in split_parts(text):
            found = parts.get(part)
            if found is None:
                found = self.older.get(part)
                if found is None:
                    found = self.encode_part(part)
                if len(part) <= LONG_PART:
                    parts[part] = found
                    self.held += ENTRY_BYTES + 2 * len(part) + len(found)
                    if 2 * self.held > CACHE_BYTES:
                        self.older, self.held = parts, 0
                        parts = self.parts = {}
            out.append(found)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.surface_size[ids]
        total = int(sizes.sum())
        where = np.repeat(self.surface_start[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        text = self.surface[where].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def split_parts(text: str) -> list[str]:
    return PART.findall(SPACE + text.replace(" ", SPACE))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def model_path(name: str) -> str:
    """Where an executor has a tokenizer file: a name of public_tokenizers, or a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_decode(df: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of texts encoded with begin and end ids, and the ids if asked for."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path(model))
        bos, eos = (np.array([x], "<u4").tobytes() for x in (e.bos, e.eos))
        last, result, array = None, (), np.zeros(0, "<u4")
        for b in batches:
            n, hashed, decoded, all_ids = [], [], [], []
            for value in b.column(1):
                text = value.as_py() or ""
                if text != last:  # rows that a mix repeats follow one another
                    last, ids = text, bos + e.encode(text) + eos
                    array = np.frombuffer(ids, "<u4")
                    result = len(array), hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(array).encode()).hexdigest()
                n.append(result[0])
                hashed.append(result[1])
                decoded.append(result[2])
                if with_ids:
                    all_ids.append(array.astype(np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        give_back()

    return _rows(df, id_col, text_col).mapInArrow(run, schema)


def frequent_parts(df: DataFrame, model: str, text_col: str = "text", sample_rows: int = 256, size: int = 20_000) -> dict[str, int]:
    """Token counts of the most frequent parts of a bounded sample, for the first tier; at most `size` short strings.

    The sample is drawn over the whole table, so that each source and language has its share.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for value in b.column(0):
                seen.update(p for p in split_parts(value.as_py() or "") if len(p) <= LONG_PART)
        top = [p for p, n in seen.most_common(size) if n > 1]
        e = encoder(model_path(model))
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array([len(e.encode_part(p)) // 4 for p in top], pa.int32())], names=["part", "n"])
        give_back()

    # About twice as many rows are drawn as are needed, and one task counts the parts of sample_rows at most.
    share = min(1.0, 2 * sample_rows / max(1, df.count()))
    sample = df.select(F.col(text_col).cast("string").alias("text")).sample(fraction=share, seed=1).limit(sample_rows).coalesce(1)
    return {r.part: r.n for r in sample.mapInArrow(count, "part string, n int").collect()}


class _Misses(dict):
    """Token counts by part: the first tier, and what a worker has encoded since."""

    def __init__(self, first: dict[str, int], model: str):
        super().__init__(first)
        self.first, self.model, self.processor, self.held = first, model, None, 0

    def __missing__(self, part: str) -> int:
        if self.processor is None:
            import sentencepiece

            self.processor = sentencepiece.SentencePieceProcessor(model_file=self.model)
        # The library puts one space before a text itself; before a part without one, that is a piece more, as the part
        # after it begins with a non-letter or follows a newline: it is encoded after a newline and both are taken off.
        if part[0] == SPACE:
            n = len(self.processor.encode(part[1:].replace(SPACE, " "))) if len(part) > 1 else 1
        else:
            n = len(self.processor.encode("\n" + part)) - 2
        if len(part) <= LONG_PART:
            self.held += ENTRY_BYTES + 2 * len(part)
            if self.held > CACHE_BYTES:
                self.clear()
                self.update(self.first)
                self.held = 0
            self[part] = n
        return n


def count_tokens(df: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, without begin and end ids."""
    first = df.sparkSession.sparkContext.broadcast(frequent_parts(df, model, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Misses(first.value, model_path(model))
        look = counts.__getitem__
        for b in batches:
            n_bytes, n = [], []
            for value in b.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n.append(sum(map(look, split_parts(text))) if text else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        counts.clear()
        give_back()

    return _rows(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
