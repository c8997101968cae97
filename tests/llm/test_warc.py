"""WARC archives: exact round trips, plain rules, damage."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from jobtables.llm.warc import (DICT_MAGIC, archived_pages, build_record, frames, parse_record,
                                read_warc, write_warc)

SF01 = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def plain(rows, min_bytes=0):
    """The contract in plain Python; ids are unique here."""
    least = {}
    for i, _, h in rows:
        p = (h or "").encode()
        least[p] = min(i, least.get(p, i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = least[p] != i and len(p) >= min_bytes
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                    "revisit" if again else "response", least[p] if again else None))
    return sorted(out)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_pages_round_trip(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    more = rows + [(10_000 + i, u, h) for i, u, h in rows[:60]]
    got = archived_pages(spark.createDataFrame(more, SCHEMA)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == plain(more)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_edges(spark, tmp_path, min_bytes):
    rows = [(1, None, None), (2, "", ""), (3, "http://a/\r\nX: y", "tiny"), (4, "é", "tiny"),
            (5, "u", "same page é " * 20000), ((1 << 60) + 1, "v", "same page é " * 20000),
            (7, "w", "\r\n\r\n"), (8, "x", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, SCHEMA) \
        .withColumns({c: F.lit(1) for c in ("payload", "key", "salt", "least", "revisit")})
    manifest = write_warc(df, str(tmp_path / "w"), min_bytes, file_bytes=300)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    got = read_warc(spark, manifest, with_payload=True).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == plain(rows, min_bytes)
    by = {r.page_id: r for r in got}
    assert by[3].target_uri == "http://a/%0D%0AX: y" and by[4].target_uri == "é"
    assert by[1].target_uri is None
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")


def test_null_and_repeated_ids(spark):
    rows = [(None, "a", "p"), (None, "b", "p"), (2, "c", "q"), (None, "d", "q"), (2, "e", "q"),
            (3, "f", "q")]
    got = archived_pages(spark.createDataFrame(rows, SCHEMA))
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got.collect()) == [
        ("2", "response", "None"), ("2", "response", "None"), ("3", "revisit", "2"),
        ("None", "response", "None"), ("None", "response", "None"), ("None", "revisit", "2")]


def test_empty_table(spark):
    assert archived_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(tmp_path, records, dictionary=b"WARC/1.1\r\nWARC-Type: response\r\n", packed=True):
    """An archive by plain library calls; every record a frame."""
    d = zstandard.ZstdCompressionDict(dictionary)
    data = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    out = struct.pack("<II", DICT_MAGIC, len(data)) + data
    for r in records:
        out += zstandard.ZstdCompressor(dict_data=d).compress(r)
    path = tmp_path / "x.warc.zst"
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize("packed", [True, False])
def test_reads_foreign_archives_and_reports_faults(spark, tmp_path, packed):
    good = build_record(1, "u", b"payload" * 50000, False, None)
    bad = [good.replace(b"WARC/1.1", b"WARC/9.9"), good[:-4], good + good,
           good.replace(b"WARC-Date", b"X-Date"), good.replace(b"payload", b"pAyload", 1),
           good.replace(b"WARC-Type: response", b"WARC-Type response"),
           b"", build_record(2, None, b"x", True, None).replace(b"WARC-Refers-To", b"X-To")]
    path = archive(tmp_path, [good, *bad, good], packed=packed)
    files = spark.createDataFrame([(path,)], "path string")
    got = read_warc(spark, files, strict=False).orderBy("offset").collect()
    assert [r.error is None for r in got] == [True] + [False] * len(bad) + [True]
    with pytest.raises(Exception, match="WARC"):
        read_warc(spark, files).collect()
    data = (tmp_path / "x.warc.zst").read_bytes()
    (tmp_path / "x.warc.zst").write_bytes(data[:-3])
    got = read_warc(spark, files, strict=False).orderBy("offset").collect()
    assert got[-1].error == "the file ends within a frame"


def test_frames_are_found_by_their_blocks():
    parts = [bytes([i % 7]) * n for i, n in enumerate((0, 1, 300000, 131072, 5))] \
        + [bytes(range(256)) * 2000]
    blob = b""
    for i, p in enumerate(parts):
        blob += zstandard.ZstdCompressor(write_checksum=bool(i % 2),
                                         write_content_size=i % 3 != 0).compress(p)
    got = [zstandard.ZstdDecompressor().decompressobj().decompress(f)
           for _, _, f in frames(io.BytesIO(blob))]
    assert got == parts
    assert parse_record(build_record(5, None, b"", False, None))["payload_bytes"] == 0
