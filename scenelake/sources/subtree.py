"""One subtree of large JSON documents: files are read up to its end and nothing else of them is parsed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = re.compile(rb'["{}\[\]:,]')
_QUOTE = re.compile(rb'["\\]')


class Scanner:
    """Finds the value of one member of the outermost object in pieces of a JSON text."""

    def __init__(self, key: str) -> None:
        self.key = key.encode()
        self.buffer = bytearray()
        self.at = 0  # how far the buffer has been looked at
        self.depth = 0
        self.string = -1  # where an open string begins
        self.name = None  # the last whole string at depth 1, if it may be a name
        self.value = -1  # where the wanted value begins

    def feed(self, part: bytes) -> bytes | None:
        """The value's text as soon as it is whole."""
        buf = self.buffer
        buf += part
        while self.at < len(buf):
            if self.string >= 0:
                hit = _QUOTE.search(buf, self.at)
                if hit is None:
                    self.at = len(buf)
                elif buf[hit.start()] == 92:  # a backslash takes the next byte with it
                    if hit.end() == len(buf):
                        self.at = hit.start()
                        return None
                    self.at = hit.end() + 1
                else:
                    if self.depth == 1:
                        self.name = bytes(buf[self.string + 1 : hit.start()])
                    self.string, self.at = -1, hit.end()
                continue
            hit = _MARK.search(buf, self.at)
            if hit is None:
                self.at = len(buf)
                break
            mark, self.at = buf[hit.start()], hit.end()
            if mark == 34:
                self.string = hit.start()
            elif mark in b"{[":
                self.depth += 1
            elif mark == 58:
                if self.depth == 1 and self.name == self.key and self.value < 0:
                    self.value = hit.end()
            else:
                if self.value >= 0 and self.depth == 1:  # a comma, or the end of the outermost object
                    return bytes(buf[self.value : hit.start()]).strip()
                if mark in b"}]":
                    self.depth -= 1
        if self.value < 0 and self.string < 0:  # what has been passed is not needed
            del buf[: self.at]
            self.at = 0
        elif self.value < 0 and self.string > 0:
            del buf[: self.string]
            self.at -= self.string
            self.string = 0
        return None


def read(spark: SparkSession, paths: str | list[str], key: str, schema: str, pattern: str = "simulation*.json", chunk: int = 1 << 16) -> DataFrame:
    """(path, value, bytes_read, bytes): the member ``key`` of each document, parsed with ``schema``, and how much was read for it.

    Spark lists the files and deals them out by name; each task opens its files and stops at the end of the member, so a
    catalogue that stands before a long time series costs what the catalogue is long. A document without the member, or
    that ends before the member does, has a null value and was read whole. Files must be in a store that Arrow opens.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths).select("path", "length")

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                scanner, text, got = Scanner(key), None, 0
                with store.open_input_file(name) as f:
                    while text is None and (part := f.read(chunk)):
                        got += len(part)
                        text = scanner.feed(part)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.binary()), pa.array([got], pa.int64()), pa.array([size], pa.int64())], ["path", "text", "bytes_read", "bytes"])

    found = listed.mapInArrow(scan, "path string, text binary, bytes_read long, bytes long")
    return found.select("path", F.from_json(F.col("text").cast("string"), schema).alias("value"), "bytes_read", "bytes")
