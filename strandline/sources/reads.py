"""FASTA and FASTQ."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import trim
from ..operators.lookup import small
from . import streams
from .ordinals import file_columns, in_file_order
from .tables import placed_lines


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq_id, name, seq): a record starts at a line that begins with ``>``; blanks inside a sequence are dropped.

    Records are split at newline and ``>``, so files are read in parallel, and numbered in the order of the files.  Text before
    the first record is left out.
    """
    if isinstance(path, str) and path.endswith(".gzip"):
        return _records(in_file_order(streams.read_stream(spark, path, "fasta"), "seq_id"))
    pieces = spark.read.option("lineSep", "\n>").text(path).select("value", *file_columns(), F.monotonically_increasing_id().alias("n"))
    # only a file's first piece keeps its mark, and without one it holds text before the first record
    firsts = pieces.filter("block = 0").groupBy("file").agg(F.min("n").alias("first"))
    told = pieces.join(small(firsts), "file", "left").withColumn("is_first", F.col("n").eqNullSafe(F.col("first")))
    value = F.when(F.col("is_first"), F.substring("value", 2, (1 << 31) - 1)).otherwise(F.col("value"))
    return _records(in_file_order(told.filter(~F.col("is_first") | F.col("value").startswith(">")).select(value.alias("value"), "file", "block"), "seq_id"))


def _records(numbered: DataFrame) -> DataFrame:
    parts = F.split("value", "\n", 2)
    seq = F.translate(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), " \t\r\n", "")
    return numbered.select("seq_id", trim(F.get(parts, F.lit(0))).alias("name"), seq.alias("seq"))


def write_fasta(df: DataFrame, path: str, compression: str | None = None) -> None:
    """One header line and one sequence line a record."""
    writer = df.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value")).write
    (writer.option("compression", compression) if compression else writer).text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, seq, qual): four lines a record, blank lines left out; marks and lengths are checked.

    ``@`` is a legal quality, so records can only be told by counting lines, which are numbered in the order of the files.  Only
    records that lie across two splits are shuffled.
    """
    filled = placed_lines(spark, path).select(trim(F.col("value")).alias("line"), "file", "block").filter("line <> ''")
    odd = filled.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter("n % 4 <> 0").first()
    if odd is not None:
        raise ValueError(f"malformed: the last read of {odd.file} is truncated")

    def run(batches):
        for b in batches:
            at, line = b.column("at").to_numpy(), b.column("line")
            n = len(at)
            begin = np.flatnonzero((at[: max(n - 3, 0)] % 4 == 0) & (at[3:] == at[: max(n - 3, 0)] + 3)) if n > 3 else np.zeros(0, np.int64)
            loose = np.ones(n, dtype=bool)
            loose[(begin[:, None] + np.arange(4)).ravel()] = False
            loose = np.flatnonzero(loose)
            ids = pa.array(np.append(at[begin], at[loose]) // 4)
            none = pa.nulls(len(loose), pa.string())
            reads = [pa.concat_arrays([line.take(pa.array(begin + k)).cast(pa.string()), none]) for k in range(4)]
            rest = pa.concat_arrays([pa.nulls(len(begin), pa.string()), line.take(pa.array(loose)).cast(pa.string())])
            place = pa.concat_arrays([pa.nulls(len(begin), pa.int32()), pa.array((at[loose] % 4).astype(np.int32))])
            yield pa.RecordBatch.from_arrays([ids, *reads, place, rest], names=["read_id", "a", "b", "c", "d", "k", "line"])

    cut = in_file_order(filled, "at").mapInArrow(run, "read_id long, a string, b string, c string, d string, k int, line string")
    across = cut.filter("k is not null").groupBy("read_id").agg(*(F.max(F.when(F.col("k") == k, F.col("line"))).alias(c) for k, c in enumerate("abcd")))
    every = cut.filter("k is null").select("read_id", "a", "b", "c", "d").unionByName(across)
    ok = F.col("a").startswith("@") & F.col("c").startswith("+") & (F.length("b") == F.length("d"))
    checked = F.assert_true(F.coalesce(ok, F.lit(False)), F.concat(F.lit("malformed read number "), F.col("read_id").cast("string")))
    rows = every.withColumn("ok", checked).filter(F.col("ok").isNull())
    return rows.select("read_id", F.substring("a", 2, 1 << 30).alias("name"), F.col("b").alias("seq"), F.col("d").alias("qual"))


def write_fastq(df: DataFrame, path: str, compression: str | None = None) -> None:
    writer = df.select(F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual")).alias("value")).write
    (writer.option("compression", compression) if compression else writer).text(path)
