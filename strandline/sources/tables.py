"""Delimited text tables.  A table is rows of cells, ``cells array<string>``; widths may differ by row."""

from __future__ import annotations

import itertools
import sys

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import rows, typed
from ..schema import ColumnKind, kinds_of_header, render_sigil
from ..session import shared_path
from . import streams
from .ordinals import TASK_BITS, file_columns, first_of, in_file_order


def read_delimited(spark: SparkSession, path: str, row_delimiter: str = "\n", cell_delimiter: str = "\t") -> DataFrame:
    """Rows and cells as they are; Spark leaves out an empty row after the last delimiter."""
    lines = spark.read.option("lineSep", row_delimiter).text(path)
    return lines.select(text.split_all(F.col("value"), cell_delimiter).alias("cells"))


def clean_cells(cells: Column, escapes: bool = True) -> Column:
    one = (lambda c: text.unescape(text.trim_escaped(c))) if escapes else text.trim
    return F.transform(cells, one)


def clean_line(line: Column, escapes: bool = True) -> Column:
    return clean_cells(F.split(line, "\t", -1), escapes)


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block) of each line; ``.gzip`` files, whose suffix Spark has no codec for, are unpacked as streams, one a task."""
    if path in ("", "-"):
        return read_lines(spark).select("value", *file_columns())
    if path.endswith(".gzip"):
        return streams.read_stream(spark, path, "lines")
    return spark.read.option("lineSep", "\n").text(path).select("value", *file_columns())


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each line."""
    return placed_lines(spark, path).select("value")


def placed_cells(spark: SparkSession, path: str, escapes: bool = True) -> DataFrame:
    """(cells, file, block) of the rows that are not empty."""
    return rows.drop_empty(placed_lines(spark, path).select(clean_line(F.col("value"), escapes).alias("cells"), "file", "block"))


def read_numbered(spark: SparkSession, path: str, escapes: bool = True) -> DataFrame:
    """(row_id, cells): rows numbered in the order of their files, the same whenever they are read."""
    if path.endswith(".bctab"):
        from . import binary

        return binary.read(spark, path)
    return in_file_order(placed_cells(spark, path, escapes))


def read_tsv(spark: SparkSession, path: str, escapes: bool = True) -> DataFrame:
    """Trimmed and unescaped cells of the rows that are not empty.

    Quotes mean nothing in this format, so Spark's CSV reader is not used.
    """
    return rows.drop_empty(lines_of(spark, path).select(clean_line(F.col("value"), escapes).alias("cells")))


def write_delimited(df: DataFrame, path: str, row_delimiter: str = "\n", cell_delimiter: str = "\t", compression: str | None = None) -> None:
    line = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), cell_delimiter)
    if path in ("", "-"):
        write_lines(df.select(line.alias("value")))
        return
    writer = df.select(line.alias("value")).write.option("lineSep", row_delimiter)
    (writer.option("compression", compression) if compression else writer).text(path)


def write_tsv(df: DataFrame, path: str, escapes: bool = True, compression: str | None = None) -> None:
    escaped = F.transform("cells", lambda c: text.escape(F.coalesce(c, F.lit("")))) if escapes else F.col("cells")
    write_delimited(df.select(escaped.alias("cells")), path, compression=compression)


def read_typed(spark: SparkSession, path: str, head: bool = True, sigil: bool = True) -> DataFrame:
    """Typed columns: the first row, read alone, gives the kinds; where it is a header that row, and no other like it, is left out."""
    if path.endswith(".bctab"):
        placed = read_numbered(spark, path)
        first = placed.filter("row_id = 0").first()
    else:
        placed = placed_cells(spark, path)
        first = first_of(placed)
    if first is None:
        raise ValueError("no header row")
    kinds = kinds_of_header(first.cells, head, sigil)
    if not head:
        rest = placed
    elif "row_id" in placed.columns:
        rest = placed.filter("row_id > 0")
    else:
        # its split is read by one task, which leaves out its first row
        own = (F.col("file") == first.file) & (F.col("block") == first.block)
        later = placed.filter(own).withColumn("place", F.monotonically_increasing_id()).filter(F.col("place").bitwiseAND((1 << TASK_BITS) - 1) > 0)
        rest = later.select("cells").unionByName(placed.filter(~own).select("cells"))
    return typed.to_typed(rest.select("cells"), kinds)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of a text table of numbers, rows in the order of their files; rows of different widths are an error."""
    placed = placed_cells(spark, path)
    width = placed.agg(F.min(F.size("cells")), F.max(F.size("cells"))).first()
    if width[0] is None:
        raise ValueError("empty matrix")
    if width[0] != width[1]:
        raise ValueError("ragged matrix")
    cells = in_file_order(placed, "i")
    return cells.select("i", F.posexplode("cells").alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), text.parse_float(F.col("v")).alias("v"))


def read_binary_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of binary matrix files (rows, columns, then numbers, all big-endian), by ranges of cells."""
    return streams.read_fixed(spark, path, "matrix", "i long, j long, v double")


def write_lines(lines: DataFrame, out=None) -> None:
    """(value) of a frame to standard output, a partition at a time."""
    out = out or sys.stdout
    for row in lines.toLocalIterator():
        out.write(row.value + "\n")


def read_lines(spark: SparkSession, source=None, batch: int = 100_000) -> DataFrame:
    """(value) of each line of standard input, stored in the shared folder a batch at a time."""
    path = shared_path(spark)
    source = sys.stdin if source is None else source
    held = [line.rstrip("\n") for line in itertools.islice(source, batch)]
    spark.createDataFrame([(x,) for x in held], "value string").coalesce(1).write.parquet(f"{path}/{0:09d}")
    n = 1
    while held := [line.rstrip("\n") for line in itertools.islice(source, batch)]:
        spark.createDataFrame([(x,) for x in held], "value string").coalesce(1).write.parquet(f"{path}/{n:09d}")
        n += 1
    return spark.read.parquet(*(f"{path}/{k:09d}" for k in range(n)))


def typed_rows(df: DataFrame, header: bool = True) -> DataFrame:
    """Text rows of typed columns with a row of sigils first."""
    from ..schema import from_struct

    body = typed.to_text(df)
    if not header:
        return body
    names = df.sparkSession.createDataFrame([([render_sigil(c) for c in from_struct(df.schema)],)], "cells array<string>")
    return names.unionByName(body)


__all__ = ["ColumnKind", "clean_cells", "clean_line", "lines_of", "read_delimited", "read_matrix", "read_tsv", "read_typed", "typed_rows", "write_delimited", "write_tsv"]
