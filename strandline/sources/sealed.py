"""Files under AES in counter mode, of which any range of bytes can be read without what is before it.

A file is the plain bytes combined with the key stream; the block that is enciphered for byte k has the nonce and the number k / 16.  A
folder has a file for each task that wrote it; its blocks are numbered from (number of the task) * 2^40, so no block is used twice
under one nonce, which the caller must not use again.  Nothing proves that the bytes are whole: seal columns (``crypto.encrypt``) for that.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import crypto
from . import binary, streams

#: Blocks of a task's file at most, as a power of two: 16 TB.
PART_BITS = 40
PIECE = streams.Pieces.width


def _pieces(batches):
    """Lines as pieces of a task's text."""
    from pyspark import TaskContext

    part, held, at = TaskContext.get().partitionId(), bytearray(), 0
    one = lambda data: pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["part", "at", "data"])
    for b in batches:
        for value in b.column("value").to_pylist():
            held += (value or "").encode() + b"\n"
            while len(held) >= PIECE:
                yield one(bytes(held[:PIECE]))
                del held[:PIECE]
                at += PIECE
    if held:
        yield one(bytes(held))


def _number(part: Column, at: Column) -> Column:
    return F.shiftleft(part.cast("bigint"), PART_BITS) + F.floor(at / 16).cast("bigint")


def write_sealed(lines: DataFrame, folder: str, key: Column, nonce: int, mode: str = "append") -> None:
    """(value) of each row as a line of text; null is an empty line.  A folder that has files is not appended to under one nonce."""
    if mode == "append" and binary.store.is_folder(folder) and binary.files_of(folder):
        raise ValueError("the folder has files whose blocks would be used again")
    cut = lines.select(F.col(lines.columns[0]).cast("string").alias("value")).mapInArrow(_pieces, "part long, at long, data binary")
    binary.write(cut.select(crypto.counter_mode(F.col("data"), key, nonce, _number(F.col("part"), F.col("at"))).alias("data")), folder, ".sealed", mode)


def read_sealed(spark: SparkSession, path: str, key: Column, nonce: int, first: int = 0, stop: int | None = None) -> DataFrame:
    """(file, at, data) of the plain bytes of a file or of each file of a folder, in pieces; those of [first, stop) where it is given.

    Partitions are ranges of bytes, to which their tasks seek.
    """
    options = {"first": first} | ({} if stop is None else {"stop": stop})
    raw = streams.read_fixed(spark, path, "pieces", "at long, data binary, file string", **options)
    part = F.coalesce(F.nullif(F.regexp_extract("file", r"-(\d{6})\.sealed$", 1), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
    plain = raw.select("file", "at", crypto.counter_mode(F.col("data"), key, nonce, _number(part, F.col("at"))).alias("data"))
    low = F.greatest(F.lit(first) - F.col("at"), F.lit(0))
    data = F.substring("data", (low + 1).cast("int"), F.lit(PIECE) if stop is None else F.greatest(F.lit(stop) - F.col("at") - low, F.lit(0)).cast("int"))
    return plain.select("file", (F.col("at") + low).alias("at"), data.alias("data")).filter(F.length("data") > 0)
