"""WARC archives: exact round trip and damaged archives."""

import pytest
from pyspark.sql import functions as F

from retrospark.llm import queries, warc
from tests.conftest import SF


def brute(rows, min_bytes=0):
    first = {}
    for i, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        again = len(data) >= min_bytes and first[h or ""] != i
        out.append((i, len(data), warc.digest(data), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_and_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert rows_of(queries.op5_warc(spark, SF)) == brute([(r.page_id, r.html) for r in pages.collect()])
    odd = [(5, "u\r\nX: y", "same", "c"), (3, None, "same", "c"), (9, "u", "same", "c"), (1, "u", None, "c"), (2, "ü", "", "c"), (7, "u", "é\r\n\r\n" * 200_000, "c"), (None, "u", "lone", "c")]
    df = spark.createDataFrame(odd, "page_id long, url string, html string, refers_to string")
    for least in (0, 1, 5):
        archives = warc.write_warc(df, min_bytes=least, archive_bytes=1000)
        back = warc.read_warc(archives, with_payload=True)
        assert rows_of(back) == brute([(r[0], r[2]) for r in odd], least)
        assert {r.page_id: bytes(r.payload).decode() for r in back.filter("record_type = 'response'").collect()} .items() <= {r[0]: r[2] or "" for r in odd}.items()
    assert warc.read_warc(warc.write_warc(df.limit(0))).count() == 0
    twice = rows_of(warc.read_warc(warc.write_warc(df.filter("page_id = 9").union(df.filter("page_id = 9")))))
    assert [r[3] for r in twice] == ["response", "response"]  # rows that are alike in identifier and payload


def test_files_and_faults(spark, tmp_path):
    good = warc.write_archive([warc.record(str(i), "u", b"payload %d" % i * 50, None) for i in range(40)])
    (tmp_path / "a.warc.zst").write_bytes(good)
    found = warc.read_warc(spark.read.format("binaryFile").load(str(tmp_path)), "path", "content")
    assert found.agg(F.sum("payload_bytes")).first()[0] == sum(len(b"payload %d" % i * 50) for i in range(40))
    for bad in (good[:-3], good[:-30], good[:4] + b"\xff\xff\xff\x7f" + good[8:], good[:-9] + bytes([good[-9] ^ 1]) + good[-8:]):
        with pytest.raises(ValueError):
            list(warc.read_archive(bad))
    whole = warc.record("1", "u", b"abc", None)
    for broken in (whole.replace(b"WARC/1.1", b"WARX/1.1"), whole.replace(b"Content-Length: 3\r\n\r\n", b"Content-Length: 4\r\n\r\n"), whole[:-1], whole.replace(b"WARC-Date", b"WARC-Dote"), whole.replace(b"abc", b"abd")):
        with pytest.raises(ValueError):
            list(warc.read_archive(warc.write_archive([broken])))
