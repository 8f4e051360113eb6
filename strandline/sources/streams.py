"""Data sources over files that are read as streams or by ranges, whatever their size.

``strandline_stream``: lines or FASTA records of gzip files under a suffix that Spark has no codec for; a file is one task's, which
holds a batch of it.  ``strandline_fixed``: files of records of fixed width after a header; a partition is a range of records, to which
its task seeks.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import store
from .blocks import LOADING_MARK

#: Bytes of text of a batch, and of records of a batch and of a partition.
TEXT, RECORDS, PART = 1 << 22, 1 << 22, 1 << 27
STREAM = "value string, file string, block long"


@dataclass
class Piece(InputPartition):
    path: str
    first: int = 0
    stop: int = 0


def unpacked(path: str) -> Iterator[str]:
    """The lines of a gzip file, which may have several members."""
    with store.open_in(path) as raw, gzip.open(raw, "rb") as data, io.TextIOWrapper(io.BufferedReader(data, 1 << 20), encoding="utf-8", errors="replace", newline="\n") as text:
        yield from text


def records(lines: Iterator[str]) -> Iterator[str]:
    """What follows each ``>`` that begins a line, up to the next."""
    held: list[str] | None = None
    for line in lines:
        if line.startswith(">"):
            if held is not None:
                yield "".join(held)
            held, line = [], line[1:]
        if held is not None:
            held.append(line)
    if held is not None:
        yield "".join(held)


class StreamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind = options.get("kind", "lines")
        self.files = store.expand(options["path"])

    def partitions(self):
        return [Piece(f) for f in self.files] or [Piece("")]

    def read(self, part: Piece):
        if not part.path:
            return
        lines = unpacked(part.path)
        values = records(lines) if self.kind == "fasta" else (x.removesuffix("\n") for x in lines)
        held: list[str] = []
        size = 0
        for v in values:
            held.append(v)
            size += len(v)
            if size > TEXT or len(held) >= 1 << 16:
                yield self._batch(held, part.path)
                held, size = [], 0
        yield self._batch(held, part.path)

    @staticmethod
    def _batch(held: list[str], path: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([path] * len(held), pa.string()), pa.array(np.zeros(len(held), np.int64))], names=["value", "file", "block"])


class Stream(DataSource):
    @classmethod
    def name(cls):
        return "strandline_stream"

    def schema(self):
        return STREAM

    def reader(self, schema):
        return StreamReader(self.options)


def read_stream(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(value, file, block) of the lines (or FASTA records) of gzip files, which may be a folder or a pattern."""
    spark.dataSource.register(Stream)
    return spark.read.format("strandline_stream").option("kind", kind).load(path)


class Matrix:
    """Numbers of rows and columns, then cells, all big-endian."""

    width = 8

    def __init__(self, file, options: dict):
        self.rows, self.columns = struct.unpack(">2Q", file.read(16))
        self.begin, self.count = 16, self.rows * self.columns
        if file.size() != 16 + 8 * self.count:
            raise ValueError("truncated matrix")

    def batch(self, data: bytes, first: int) -> pa.RecordBatch:
        v = np.frombuffer(data, ">f8").astype(float)
        at = np.arange(first, first + len(v))
        return pa.RecordBatch.from_arrays([pa.array(at // self.columns), pa.array(at % self.columns), pa.array(v)], names=["i", "j", "v"])


class Loadings:
    """Simulated counts by loading, genotype and repetition, in the byte order of the machine."""

    def __init__(self, file, options: dict):
        mark, self.alleles, _, n = struct.unpack("=4Q", file.read(32))
        if mark != LOADING_MARK:
            raise ValueError("a file of a machine with another byte order")
        *ploidies, self.fan = struct.unpack(f"={n + 1}Q", file.read(8 * n + 8))
        self.genos, self.begin, self.width = self.alleles ** sum(ploidies), 40 + 8 * n, 8 * self.alleles
        if (file.size() - self.begin) % (self.width * self.genos * self.fan):
            raise ValueError("truncated loadings")
        self.count = (file.size() - self.begin) // self.width

    def batch(self, data: bytes, first: int) -> pa.RecordBatch:
        counts = np.frombuffer(data, "=i8")
        n = len(counts) // self.alleles
        at = np.arange(first, first + n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.alleles, pa.int32()), pa.array(counts))
        columns = [pa.array((at // (self.genos * self.fan)).astype(np.int32)), pa.array(at // self.fan % self.genos), pa.array((at % self.fan).astype(np.int32)), lists]
        return pa.RecordBatch.from_arrays(columns, names=["load_idx", "geno_idx", "rep", "counts"])


class Scored:
    """Scored reads, in the byte order of the machine."""

    def __init__(self, file, options: dict):
        from .samples import record

        self.kind = record(int(options["alleles"]), int(options["individuals"]))
        self.begin, self.width = 0, self.kind.itemsize
        if file.size() % self.width:
            raise ValueError("truncated record")
        self.count = file.size() // self.width

    def batch(self, data: bytes, first: int) -> pa.RecordBatch:
        rows = np.frombuffer(data, self.kind)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in self.kind.names], names=list(self.kind.names))


class Pieces:
    """The bytes of a file in pieces of whole cipher blocks."""

    width = 1 << 16

    def __init__(self, file, options: dict):
        self.begin, self.size = 0, file.size()
        self.count = -(-self.size // self.width)
        self.first, self.stop = int(options.get("first", 0)) // self.width, -(-int(options.get("stop", self.size)) // self.width)

    def batch(self, data: bytes, first: int) -> pa.RecordBatch:
        cut = [data[i : i + self.width] for i in range(0, len(data), self.width)]
        return pa.RecordBatch.from_arrays([pa.array((first + np.arange(len(cut))) * self.width), pa.array(cut, pa.binary())], names=["at", "data"])


KINDS = {"pieces": Pieces, "matrix": Matrix, "loadings": Loadings, "scored": Scored}


class FixedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.shape = KINDS[options["kind"]]
        self.part = int(options.get("part", PART))

    def partitions(self):
        out = []
        for path in store.expand(self.options["path"]):
            with store.open_in(path) as file:
                shape = self.shape(file, self.options)
            step = max(1, self.part // shape.width)
            low, high = max(0, getattr(shape, "first", 0)), min(shape.count, getattr(shape, "stop", shape.count))
            out += [Piece(path, i, min(high, i + step)) for i in range(low, high, step)]
        return out or [Piece("")]

    def read(self, part: Piece):
        if not part.path:
            return
        with store.open_in(part.path) as file:
            shape = self.shape(file, self.options)
            step = max(1, RECORDS // shape.width)
            for i in range(part.first, part.stop, step):
                n = min(part.stop, i + step) - i
                wanted = min(n * shape.width, file.size() - shape.begin - i * shape.width)  # only the last piece of bytes may be shorter
                file.seek(shape.begin + i * shape.width)
                data = file.read(wanted)
                if len(data) != wanted or (wanted != n * shape.width and self.options["kind"] != "pieces"):
                    raise ValueError("read beyond the end")
                batch = shape.batch(data, i)
                yield batch.append_column("file", pa.array([part.path] * batch.num_rows, pa.string())) if self.options["kind"] == "pieces" else batch


class Fixed(DataSource):
    @classmethod
    def name(cls):
        return "strandline_fixed"

    def schema(self):
        return self.options["columns"]

    def reader(self, schema):
        return FixedReader(self.options)


def read_fixed(spark: SparkSession, path: str, kind: str, columns: str, **options) -> DataFrame:
    """Records of files (a path, a folder or a pattern) of fixed width; options are the shape's own, and ``part``, the bytes of a partition."""
    spark.dataSource.register(Fixed)
    reader = spark.read.format("strandline_fixed").option("kind", kind).option("columns", columns)
    return reader.options(**{k: str(v) for k, v in options.items()}).load(path)
