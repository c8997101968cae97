"""Token ids as length-delimited binary records with an offset index.

Record file (``.rec``), per record, little-endian:

    uint64 length | uint32 masked CRC of the length | payload | uint32 masked CRC of the payload

The payload is one byte of flags (1: the document id is not null, 2: ids take
four bytes), the int64 document id and the token ids as uint16, or uint32 if the
vocabulary needs it.  The CRC is zlib's CRC-32, masked (no CRC-32C is at hand
in Python tasks).  Index file (``.idx``): 8 bytes of magic, uint64 count, one
uint64 offset per record, uint32 masked CRC of all before; with it records can
be read in any order.  A manifest table (one row per file) is committed by
Spark, so files of failed or repeated task attempts are never read.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtables.llm.files import masked_crc, open_fs
from jobtables.llm.shared import Scratch, shuffle_partitions

MAGIC = b"TOKIDX01"
FILE_BYTES = 64 << 20
_BLANKS = re.compile(r"\s\s")
_WIDE = 2  # flag of a payload
_MANIFEST = "part int, seq int, path string, n_records long, n_tokens long, n_bytes long"
_READ_ROWS = 4096
_READ_BYTES = 16 << 20


class Encoder:
    """Byte-level BPE of whole texts, remembering the words it has met.

    A single blank or line feed between other characters always ends a token,
    so a text may be cut there; texts with two blanks of any kind in a row
    are encoded as one piece.  A word of Latin letters is a pre-token of its own and goes to the
    BPE model directly.  Two generations of at most ``capacity`` words each
    bound the memory.  With ``added_tokens`` the strings of the vocabulary's
    added tokens become their ids, as in the library's default, and texts that
    hold one are encoded as one piece; else they are ordinary text.
    """

    def __init__(self, vocabulary: str, end_id: int, capacity: int = 400_000,
                 added_tokens: bool = False):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(vocabulary)
        self._tok.encode_special_tokens = not added_tokens
        added = [t.content for t in self._tok.get_added_tokens_decoder().values()] if added_tokens else []
        self._in_one = re.compile("|".join([_BLANKS.pattern, *map(re.escape, added)]))
        wide = max(end_id, self._tok.get_vocab_size() - 1) >= 1 << 16
        self.dtype, self._code = ("<u4", "I") if wide else ("<u2", "H")
        self._end = np.array([end_id], self.dtype).tobytes()
        self._model = self._tok.model
        # how the pre-tokenizer spells the bytes of Latin letters, and a blank
        spell = lambda c: "".join(p for p, _ in self._tok.pre_tokenizer.pre_tokenize_str(c))
        self._blank = spell(" ")
        self._spelling = {}
        for c in map(chr, range(0xC0, 0x250)):
            self._spelling |= dict(zip(c.encode(), spell(c)))
        # by whether a blank comes before: word -> ids, of now and of before
        self._new: tuple[dict, dict] = ({}, {})
        self._old: tuple[dict, dict] = ({}, {})
        self._capacity = capacity

    def _whole(self, text: str) -> bytes:
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encode(self, word: str, blank: bool) -> bytes:
        if word.isalpha() and max(word) < "\u0250" and min(word) not in "ªº":
            spelt = word if word.isascii() else \
                word.encode().decode("latin-1").translate(self._spelling)
            got = self._model.tokenize(self._blank + spelt if blank else spelt)
            return struct.pack(f"<{len(got)}{self._code}", *[t.id for t in got])
        core = word.rstrip(".,;:!?%*&$#|)")
        if core != word and core and core[-1].isalpha():  # a new token begins after a letter
            return self._word(core, blank) + self._word(word[len(core):], False)
        return self._whole(" " + word if blank else word)

    def _word(self, word: str, blank: bool) -> bytes:
        ids = self._new[blank].get(word)
        if ids is None:
            ids = self._old[blank].get(word)
            if ids is None:
                ids = self._encode(word, blank)
            if len(word) <= 64:
                if len(self._new[blank]) >= self._capacity:
                    self._old, self._new = self._new, ({}, {})
                self._new[blank][word] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        """Ids in little-endian ``dtype``, the end id last."""
        if not text:
            return self._end
        if self._in_one.search(text):
            return self._whole(text) + self._end
        out = []
        for n, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            ids = [*map(self._new[True].get, rest)]
            if None in ids:
                ids = [self._word(w, True) if i is None else i for i, w in zip(ids, rest)]
            if n:
                out.append(self._word("\n", False))
            if first:
                out.append(self._word(first, False))
            out += ids
        out.append(self._end)
        return b"".join(out)


@lru_cache(maxsize=1)
def _encoder(vocabulary: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a Python worker, with the words it knows."""
    return Encoder(vocabulary, end_id, added_tokens=True)


class _File:
    def __init__(self, uri: str):
        self.uri, self.offsets, self.at, self.tokens = uri, array("Q"), 0, 0
        self._fs, self._path = open_fs(uri + ".rec")
        self._fs.create_dir(self._path.rsplit("/", 1)[0], recursive=True)
        self._out = self._fs.open_output_stream(self._path)

    def add(self, payload: bytes, n_tokens: int) -> None:
        head = struct.pack("<Q", len(payload))
        record = b"".join([head, struct.pack("<I", masked_crc(head)), payload,
                           struct.pack("<I", masked_crc(payload))])
        self.offsets.append(self.at)
        self._out.write(record)
        self.at += len(record)
        self.tokens += n_tokens

    def close(self) -> tuple[int, int, int]:
        self._out.close()
        body = MAGIC + struct.pack("<Q", len(self.offsets)) \
            + np.array(self.offsets, "<u8").tobytes()
        with self._fs.open_output_stream(self._path[:-4] + ".idx") as f:
            f.write(body + struct.pack("<I", masked_crc(body)))
        return len(self.offsets), self.tokens, self.at


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2,
                  file_bytes: int = FILE_BYTES, partitions: int | None = None) -> DataFrame:
    """Encode ``text`` of every row and write the records in ascending
    ``doc_id`` order (nulls first, equal ids by text hash) below ``folder``.

    Ids are the library's, ``add_special_tokens=False`` and nothing else: the
    string of an added token in a text becomes that token's id.
    Returns the manifest ``(part, seq, path, n_records, n_tokens, n_bytes)``,
    read back from ``folder``; files in (part, seq) order hold the ids in
    order.  Null and empty texts are the end id alone.  An empty table writes
    no record files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                       F.xxhash64("text").alias("tie")) \
        .withColumn("n", F.monotonically_increasing_id())
    keys = ["doc_id", "tie", "n"]
    ordered = rows.repartitionByRange(partitions or shuffle_partitions(spark), *keys) \
        .sortWithinPartitions(*keys).select("doc_id", "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encode, file, seq = _encoder(vocabulary, end_id), None, 0

        def closed() -> pd.DataFrame:
            return pd.DataFrame([(part, seq, file.uri, *file.close())],
                                columns=[c.split()[0] for c in _MANIFEST.split(", ")])

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encode(text)
                if file is None:
                    file = _File(f"{folder}/records/{part:06d}-{seq:04d}-{attempt}")
                known = not pd.isna(doc_id)
                size = np.dtype(encode.dtype).itemsize
                file.add(struct.pack("<Bq", known | _WIDE * (size == 4),
                                     int(doc_id) if known else 0) + ids, len(ids) // size)
                if file.at >= file_bytes:
                    yield closed()
                    file, seq = None, seq + 1
        if file is not None:
            yield closed()

    # as text: long ids with nulls among them would become floats in pandas
    manifest = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text") \
        .mapInPandas(write, _MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_index(uri: str) -> np.ndarray:
    """Offsets of a file's records; raises if the index is damaged."""
    fs, path = open_fs(uri + ".idx")
    with fs.open_input_stream(path) as f:
        data = f.read()
    if data[:8] != MAGIC or struct.unpack("<I", data[-4:])[0] != masked_crc(data[:-4]):
        raise ValueError(f"damaged index: {uri}.idx")
    offsets = np.frombuffer(data[16:-4], "<u8")
    if len(offsets) != struct.unpack("<Q", data[8:16])[0]:
        raise ValueError(f"index has another length than it says: {uri}.idx")
    return offsets


def read_at(f, uri: str) -> bytes | None:
    """The payload of the record at the stream's position; None at the end."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError(f"damaged length in {uri}.rec")
    n = struct.unpack("<Q", head[:8])[0]
    data = f.read(n + 4)
    if len(data) < n + 4 or struct.unpack("<I", data[n:])[0] != masked_crc(data[:n]):
        raise ValueError(f"damaged or cut record in {uri}.rec")
    return data[:n]


def read_payloads(uri: str, shuffle_seed: int | None = None) -> Iterator[tuple[int, bytes]]:
    """``(number, payload)`` of every record of a file, checked, one at a time;
    in a seeded random order by way of the index if a seed is given."""
    offsets = read_index(uri)
    fs, path = open_fs(uri + ".rec")
    if shuffle_seed is None:
        with fs.open_input_stream(path, buffer_size=1 << 20) as f:
            n = 0
            while (payload := read_at(f, uri)) is not None:
                yield n, payload
                n += 1
        if n != len(offsets):
            raise ValueError(f"{uri}.rec has {n} records, its index {len(offsets)}")
    else:
        with fs.open_input_file(path) as f:
            for i in np.random.default_rng(shuffle_seed).permutation(len(offsets)):
                f.seek(int(offsets[i]))
                yield int(i), read_at(f, uri)


def _ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and token ids (uint32) of a payload."""
    flags, doc_id = struct.unpack("<Bq", payload[:9])
    ids = np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", offset=9).astype("<u4")
    return (doc_id if flags & 1 else None), ids


def read_records(spark: SparkSession, manifest: DataFrame, with_ids: bool = False,
                 shuffle_seed: int | None = None) -> DataFrame:
    """One row per record: ``doc_id, start, n_tokens, ids_crc32`` and, if asked
    for, ``ids``; ``start`` counts the ids of all records before it.

    With a seed each file is read in a random order through its index.  A
    damaged length, record or index fails the read.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))) \
        .select("path", "base").repartition(shuffle_partitions(spark))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list) -> pd.DataFrame:
            pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            return pdf.astype({"doc_id": "Int64"})

        for pdf in batches:
            for path, base in zip(pdf["path"], pdf["base"]):
                starts = None
                if shuffle_seed is not None:  # ids before each record, from a first pass
                    counts = [len(_ids(p)[1]) for _, p in read_payloads(path)]
                    starts = base + np.concatenate([[0], np.cumsum(counts)])
                rows, held, start = [], 0, int(base)
                for n, payload in read_payloads(path, shuffle_seed):
                    doc_id, ids = _ids(payload)
                    if starts is not None:
                        start = int(starts[n])
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
                                + ((ids.astype(np.int32),) if with_ids else ()))
                    start += len(ids)
                    held += 4 * len(ids) * with_ids
                    if len(rows) >= _READ_ROWS or held >= _READ_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    return files.mapInPandas(read, schema)


def token_records(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the records of ``docs`` to a folder of their own in the shared
    folder and read them back (see ``write_records``, ``read_records``).

    Repeated rows and ids give a record each; columns other than ``doc_id``
    and ``text`` are not read.
    """
    spark = docs.sparkSession
    folder = Scratch(spark, "tokens").path("records")
    return read_records(spark, write_records(docs, folder, vocabulary, end_id))
