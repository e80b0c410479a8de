"""BSON files as DataFrames: concatenated documents, and record logs.

A log has a header of 64 bytes that starts with b"CBD1", then records of a status byte (0x01 live, 0x02 deleted)
and a document. Like a dump, it is read up to the first record that isn't well-formed; what follows is never guessed at.
Files are read through Spark, from any store that it reads.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.bson import is_valid

HEADER, LIVE, DELETED = 64, 0x01, 0x02


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, document) of the live documents of a file."""
    log = data[:4] == b"CBD1"
    at = HEADER if log else 0
    while at < len(data):
        status = data[at] if log else LIVE
        start = at + log
        if status not in (LIVE, DELETED) or start + 5 > len(data):
            return
        size = struct.unpack_from("<i", data, start)[0]
        document = data[start : start + size]
        if size < 5 or len(document) < size or not is_valid(document):
            return
        if status == LIVE:
            yield at, document
        at = start + size


def read_bson(spark: SparkSession, path: str) -> DataFrame:
    """``path, position, doc`` (BSON bytes) of the documents of all files under a path."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = list(records(content.as_py()))
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([p for p, _ in part], pa.int64()), pa.array([d for _, d in part], pa.binary())], names=["path", "position", "doc"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(split, "path string, position long, doc binary")


def write_bson(df: DataFrame, column: str = "doc") -> bytes:
    """The documents of a small result as one file's bytes."""
    return b"".join(bytes(r[0]) for r in df.select(column).toLocalIterator())
