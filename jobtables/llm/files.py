"""Reading and writing byte files of the shared folder from Python tasks."""

from __future__ import annotations

import re


def open_fs(uri: str):
    """``(filesystem, path)`` of a URI: local, HDFS, S3 or GCS."""
    from pyarrow import fs
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    uri = re.sub(r"^(s3a|s3n):", "s3:", uri)
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def masked_crc(data: bytes) -> int:
    """CRC-32 rotated by 15 bits plus a constant, so that a checksum of data
    that itself holds checksums stays a good one."""
    import zlib
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF
