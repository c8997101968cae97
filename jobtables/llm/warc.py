"""WARC archives in Zstandard files: writer and reader.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a Zstandard frame; every record is one frame compressed
with it.  A repeated payload is stored once: the record with the smallest page
id is the response and the others are ``revisit`` records that refer to it and
keep the HTTP header only.  The reader walks the frames by their block sizes,
holds one record at a time, and checks header, lengths and digests.  A
manifest table (one row per file) is committed by Spark, so files of failed or
repeated task attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtables.llm.files import open_fs
from jobtables.llm.sampling import smallest_hashes
from jobtables.llm.shared import Scratch, shuffle_partitions

DICT_MAGIC, SKIP_LOW, SKIP_HIGH, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0x184D2A5F, 0xFD2FB528
DICT_BYTES, SAMPLE_PAGES, SAMPLE_CHARS = 64 << 10, 500, 16 << 10
FILE_BYTES, SALTS, LEVEL = 64 << 20, 16, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
_MANIFEST = "path string, n_records long, n_bytes long"
_FIELDS = ("path string, offset long, record_type string, record_id string, page_id long, "
           "target_uri string, payload_bytes long, payload_digest string, refers_to long, "
           "error string")
_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
_BATCH_ROWS, _BATCH_BYTES = 2048, 16 << 20


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(m[1]) if m else None


def _line_safe(url: str) -> bytes:
    """A header value on one line: control characters percent-encoded."""
    return re.sub(rb"[\x00-\x1f\x7f]", lambda m: b"%%%02X" % m[0][0],
                  url.strip().encode("utf-8", "surrogatepass"))


def build_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool,
                 refers_to: int | None) -> bytes:
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if revisit else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
            b"WARC-Record-ID: " + _record_id(page_id).encode(), b"WARC-Date: " + DATE.encode(),
            b"Content-Type: application/http; msgtype=response",
            b"WARC-Payload-Digest: sha1:" + digest(payload).encode(),
            b"WARC-Block-Digest: sha1:" + digest(block).encode()]
    if url:
        head.append(b"WARC-Target-URI: " + _line_safe(url))
    if revisit:
        head += [b"WARC-Profile: " + PROFILE.encode(),
                 b"WARC-Refers-To: " + _record_id(refers_to).encode()]
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises ValueError where it breaks the format."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not blank or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    for name in _REQUIRED:
        if not fields.get(name):
            raise ValueError(f"no {name}")
    if not re.fullmatch(r"[0-9]+", fields["content-length"]):
        raise ValueError("bad content-length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"content-length is {n}, the frame holds {len(rest) - 4}")
    block, kind = rest[:n], fields["warc-type"]
    if fields.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise ValueError("block digest differs")
    payload, size = block, n
    if fields.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise ValueError("no HTTP header")
        m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        size = int(m[1]) if m else len(payload)
        if kind == "response" and size != len(payload):
            raise ValueError(f"HTTP content-length is {size}, the payload has {len(payload)}")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        if payload and said != digest(payload):
            raise ValueError("payload digest differs")
        if not said or not fields.get("warc-refers-to"):
            raise ValueError("a revisit without payload digest or reference")
    elif said and said != digest(payload):
        raise ValueError("payload digest differs")
    return {"record_type": kind, "record_id": fields["warc-record-id"],
            "page_id": _page_id(fields["warc-record-id"]),
            "target_uri": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": size,
            "payload_digest": said or digest(payload),
            "refers_to": _page_id(fields.get("warc-refers-to"))}


def frames(f) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, magic, bytes)`` of each frame of a stream, found by its
    block sizes without decompressing; skippable frames give their content."""
    at = 0

    def take(n: int) -> bytes:
        data = f.read(n)
        if len(data) < n:
            raise ValueError("the file ends within a frame")
        return data

    while head := f.read(4):
        if len(head) < 4:
            raise ValueError("the file ends within a frame")
        magic = struct.unpack("<I", head)[0]
        if SKIP_LOW <= magic <= SKIP_HIGH:
            size = take(4)
            data = take(struct.unpack("<I", size)[0])
            yield at, magic, data
            at += 8 + len(data)
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        d = take(1)
        flags = d[0]
        single = flags >> 5 & 1
        parts = [head, d, take((not single) + (0, 1, 2, 4)[flags & 3]
                               + (single, 2, 4, 8)[flags >> 6])]
        last = 0
        while not last:
            h = take(3)
            word = int.from_bytes(h, "little")
            last, kind, size = word & 1, word >> 1 & 3, word >> 3
            if kind == 3:
                raise ValueError("reserved block type")
            parts += [h, take(1 if kind == 1 else size)]
        if flags >> 2 & 1:
            parts.append(take(4))
        data = b"".join(parts)
        yield at, magic, data
        at += len(data)


def read_file(uri: str, strict: bool = True) -> Iterator[tuple[int, dict | None, str | None]]:
    """``(offset, record, error)`` of each record of a file.  With ``strict``
    the first fault raises; else a faulty record gives its error, and a
    damaged frame ends the file."""
    import zstandard
    fs, path = open_fs(uri)
    decoder, offset = zstandard.ZstdDecompressor(), 0
    with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
        try:
            for n, (offset, magic, data) in enumerate(frames(f)):
                if magic == DICT_MAGIC and n == 0:
                    if data[:4] == struct.pack("<I", FRAME_MAGIC):
                        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                    decoder = zstandard.ZstdDecompressor(
                        dict_data=zstandard.ZstdCompressionDict(data))
                if magic != FRAME_MAGIC:
                    continue
                try:
                    text = decoder.decompressobj()
                    record = parse_record(text.decompress(data))
                except (ValueError, zstandard.ZstdError) as e:
                    if strict:
                        raise
                    yield offset, None, str(e)
                else:
                    yield offset, record, None
        except (ValueError, zstandard.ZstdError) as e:
            if strict:
                raise ValueError(f"{uri}, byte {offset}: {e}") from e
            yield offset, None, str(e)


def train_dictionary(pages: DataFrame, text: str = "html") -> bytes:
    """A dictionary trained on at most ``SAMPLE_PAGES`` pages, chosen by the
    smallest hashes of id and url, the first ``SAMPLE_CHARS`` characters of
    each; it bears on the ratio only.  Too few samples give plain content
    instead."""
    import zstandard
    rows = smallest_hashes(
        pages.select(F.substring(F.col(text), 1, SAMPLE_CHARS).alias("t"),
                     F.xxhash64("page_id", "url").alias("h")), F.col("h"), SAMPLE_PAGES, pages.count()) \
        .where("t <> ''").groupBy("h").agg(F.min("t").alias("t")) \
        .orderBy("h").limit(SAMPLE_PAGES).collect()
    samples = [build_record(k, None, r["t"].encode("utf-8", "surrogatepass"), False, None)
               for k, r in enumerate(rows)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (build_record(None, None, b"", True, None) + b"".join(samples[:4]))[:DICT_BYTES]


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to, revisit`` of each page.

    Of equal payloads of at least ``min_bytes`` bytes the smallest page id is
    the response (rows that repeat it too); a null id is one only if all of
    the group are.  Groups of copies are counted before they are joined, and
    the join is salted, so that a large group lies on many tasks.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= min_bytes,
                                         F.sha2("payload", 256))) \
        .withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    groups = rows.where("key IS NOT NULL").groupBy("key") \
        .agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1") \
        .select("key", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    other = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    return rows.join(groups, ["key", "salt"], "left").select(
        "page_id", "url", "payload", F.when(other, F.col("least")).alias("refers_to"),
        other.alias("revisit"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES
               ) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` below
    ``folder``; returns the manifest ``(path, n_records, n_bytes)``, read back
    from there.  A null html is an empty payload, a null or empty url gives no
    target header, and an empty table no files."""
    spark = pages.sparkSession
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary.value)
        start = struct.pack("<II", DICT_MAGIC, len(packed)) + packed
        encoder = zstandard.ZstdCompressor(
            level=LEVEL, write_checksum=True, write_content_size=True,
            dict_data=zstandard.ZstdCompressionDict(dictionary.value))
        out, seq, n, size, uri = None, 0, 0, 0, ""

        def closed() -> pd.DataFrame:
            out.close()
            return pd.DataFrame([(uri, n, size)], columns=["path", "n_records", "n_bytes"])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None:
                    uri = f"{folder}/archives/{part:06d}-{seq:04d}-{attempt}.warc.zst"
                    fs, path = open_fs(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, n, size = fs.open_output_stream(path, compression=None), 0, len(start)
                    out.write(start)
                ids = [None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to)]
                frame = encoder.compress(build_record(ids[0], r.url, bytes(r.payload),
                                                      bool(r.revisit), ids[1]))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= file_bytes:
                    yield closed()
                    out, seq = None, seq + 1
        if out is not None:
            yield closed()

    # ids as text: long ids with nulls among them would become floats in pandas
    rows = with_revisits(pages, min_bytes).withColumns(
        {c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    rows.mapInPandas(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_warc(spark: SparkSession, files: DataFrame, strict: bool = True,
              with_payload: bool = False) -> DataFrame:
    """One row per record of the archives named by ``files(path)``: place,
    type, ids, target, size and digest of the full payload, reference, error
    and, if asked for, the payload (of a revisit: empty)."""
    schema = _FIELDS + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype(
                {c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})

        for pdf in batches:
            for uri in pdf["path"]:
                rows, held = [], 0
                for offset, record, error in read_file(uri, strict):
                    record = {"path": uri, "offset": offset, "error": error} | (record or {})
                    rows.append(tuple(record.get(c) for c in names))
                    held += len(record.get("payload") or b"") * with_payload
                    if len(rows) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    return files.select("path").repartition(shuffle_partitions(spark)).mapInPandas(read, schema)


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages`` to a folder of their own in the shared
    folder and read the records back."""
    folder = Scratch(pages.sparkSession, "warc").path("warc")
    return read_warc(pages.sparkSession, write_warc(pages, folder, min_bytes))

