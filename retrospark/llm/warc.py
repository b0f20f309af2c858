"""WARC archives compressed with Zstandard and a dictionary.

An archive begins with a skippable frame that holds the dictionary; after it, each record is a frame of its own. The
writer makes one record for each page; of pages with equal payloads the one with the smallest identifier is a response
and the others are revisits that name it. Archives are rows (archive, content) of bounded size, so that a table of any
store that Spark writes to can hold them; the reader takes such rows, or those of Spark's binaryFile source.

The reader finds the frames by their block headers, decodes each with the dictionary, and checks: version line,
mandatory headers, Content-Length against what follows, the closing blank lines, the block digest, and for responses
the payload digest. A record that fails raises ValueError with the archive's name and the record's offset.

Defined results: a null payload counts as empty; pages with a null identifier are written with an empty one and read
back as null; repeated rows (identifier and payload) are alike, all responses where no smaller identifier
has the payload, else all revisits; an empty table gives no archives; very long payloads make an archive of their own; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 8 << 20
DICT_BYTES, DICT_SAMPLE_BYTES = 16 << 10, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    import zstandard

    sample, size = [], 0
    for r in records:
        if size > DICT_SAMPLE_BYTES:
            break
        sample.append(r[:65536])
        size += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, sample)
    except zstandard.ZstdError:  # too little to learn from
        trained = zstandard.ZstdCompressionDict(b"".join(sample)[:DICT_BYTES] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data = trained.as_bytes()
    c = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(data)), data, *map(c.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from its header and its blocks' headers."""
    if int.from_bytes(data[at : at + 4], "little") != FRAME_MAGIC:
        raise ValueError("no frame begins here")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if at > len(data):
            raise ValueError("the frame is cut off")
        if block & 1:
            end = at + 4 * (flags >> 2 & 1)
            if end > len(data):
                raise ValueError("the frame is cut off")
            return end


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1") or not gap:
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"a header without a colon: {line[:40]}")
        fields[name] = value.strip()
    if missing := [m for m in MANDATORY if m not in fields]:
        raise ValueError(f"no {missing[0]}")
    n = int(fields["Content-Length"])
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the record")
    block = rest[:n]
    if fields.get("WARC-Block-Digest", "") not in ("", f"sha1:{digest(block)}"):
        raise ValueError("the block digest doesn't fit")
    return fields, block


def parse_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError("the block isn't an HTTP response")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, payload


def read_archive(content: bytes) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes]]:
    """(offset, WARC headers, HTTP headers, payload) of each record."""
    import zstandard

    data, at, reader = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            n = int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 + n > len(data):
                raise ValueError(f"at {at}: the skippable frame is cut off")
            if at == 0 and magic == DICT_MAGIC:
                raw = bytes(data[8 : 8 + n])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + n
            continue
        try:
            end = frame_end(data, at)
            fields, block = parse_record(reader.decompressobj().decompress(data[at:end]))
            http, payload = parse_http(block)
            if fields["WARC-Type"] == "response":
                if int(http.get("content-length", len(payload))) != len(payload):
                    raise ValueError("the HTTP length doesn't fit")
                if fields.get("WARC-Payload-Digest", "") not in ("", f"sha1:{digest(payload)}"):
                    raise ValueError("the payload digest doesn't fit")
        except (ValueError, zstandard.ZstdError) as e:
            raise ValueError(f"at {at}: {e}") from e
        yield at, fields, http, payload
        at = end


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to. Payloads below min_bytes are never revisits.

    Equal payloads are found by SHA-256 and length on narrow rows; payloads move only once, by identifier and digest, and
    evenly. Repeated rows with one identifier and one payload are alike: all response or all revisit.
    """
    payload = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("h", F.sha2("payload", 256))
    narrow = rows.select("page_id", "h", F.octet_length("payload").alias("bytes")).filter(F.col("bytes") >= min_bytes)
    first = narrow.groupBy("h", "bytes").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = narrow.join(first, ["h", "bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    later = later.select(F.col("page_id").alias("later"), F.col("h").alias("later_h"), F.col("first.page_id").alias("refers_to"), F.lit(True).alias("revisit")).distinct()
    joined = rows.join(later, F.col("page_id").eqNullSafe(F.col("later")) & (F.col("h") == F.col("later_h")), "left")
    return joined.select("page_id", "url", "payload", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive string, content binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def archive() -> pd.DataFrame:
            content = write_archive(held)
            return pd.DataFrame({"archive": [f"{hashlib.sha256(content).hexdigest()[:20]}.warc.zst"], "content": [content]})

        for b in batches:
            for page, url, payload, refers, revisit in zip(b.page_id, b.url, b.payload, b.refers_to, b.revisit, strict=True):
                name = lambda x: "" if pd.isna(x) else str(int(x))
                clean = "" if url is None else " ".join(str(url).split())
                held.append(record(name(page), clean, bytes(payload), name(refers) if revisit else None))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    marked = mark_revisits(pages, id_col, url_col, text_col, min_bytes)
    text_id = marked.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return text_id.mapInPandas(run, "archive string, content binary")


def read_warc(archives: DataFrame, name_col: str = "archive", content_col: str = "content", with_payload: bool = False) -> DataFrame:
    """archive, offset, page_id, url, record_type, payload_bytes, payload_digest, refers_to, and the payload if asked for.

    Length and digest of a revisit are those of the full payload, which its HTTP header and its WARC header hold.
    """
    schema = "archive string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda s: int(s[len("<urn:page:") : -1]) if s and len(s) > 11 else None
        for b in batches:
            for archive, content in zip(b.archive, b.content, strict=True):
                out = []
                try:
                    for at, fields, http, payload in read_archive(content):
                        size = len(payload) if fields["WARC-Type"] == "response" else int(http["content-length"])
                        out.append((archive, at, number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), number(fields.get("WARC-Refers-To")), payload))
                except ValueError as e:
                    raise ValueError(f"{archive}: {e}") from e
                cols = ["archive", "offset", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                frame = pd.DataFrame(out, columns=cols)
                frame = frame.astype({"page_id": "Int64", "refers_to": "Int64"})
                yield frame if with_payload else frame.drop(columns="payload")

    return archives.select(F.col(name_col).cast("string").alias("archive"), F.col(content_col).alias("content")).mapInPandas(run, schema)

