"""Text rows to typed columns and back, and the model of missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..schema import ColumnKind, from_struct, to_struct

INTEGER, REAL = "^[-+0-9]+$", "^[-+0-9.eE]+$"


def cell_value(cell: Column, c: ColumnKind) -> Column:
    """The typed value of a text cell; what does not fit is null.

    A text such as 1-2 passes the character test of integers but is no number, so it is null here.
    """
    if c.kind == "int":
        return F.when(cell.rlike(INTEGER), cell.try_cast("bigint"))
    if c.kind == "real":
        return F.when(cell.rlike(REAL), cell.try_cast("double"))
    if c.kind == "cat":
        return F.when(cell.isin(list(c.levels)), cell) if c.levels else F.lit(None).cast("string")
    return text.fixed_string(cell, c.length)


def to_typed(df: DataFrame, kinds: list[ColumnKind], cells: str = "cells", strict: bool = True) -> DataFrame:
    """Columns from the cells of each row; other columns stay.  strict: a row of another width is an error."""
    rest = [c for c in df.columns if c != cells]
    row = F.col(cells)
    if strict:
        row = F.when(F.assert_true(F.size(row) == len(kinds), F.lit("a row has another number of cells than the header")).isNull(), row)
    fields = to_struct(kinds).fields
    return df.select(*rest, row.alias(cells)).select(*rest, *(cell_value(F.get(cells, F.lit(i)), c).alias(c.name, metadata=f.metadata) for i, (c, f) in enumerate(zip(kinds, fields, strict=True))))


def cell_text(value: Column, kind: str) -> Column:
    """The text of a typed value; a missing one is empty."""
    if kind == "real":
        value = F.when(value.isNotNull(), F.format_string("%e", value))
    return F.coalesce(value.cast("string"), F.lit(""))


def to_text(df: DataFrame, columns: list[str] | None = None, cells: str = "cells") -> DataFrame:
    """Rows of text cells from typed columns."""
    kinds = [c for c in from_struct(df.schema) if columns is None or c.name in columns]
    rest = [c for c in df.columns if c not in {k.name for k in kinds}]
    return df.select(*rest, F.array(*(cell_text(F.col(f"`{k.name}`"), k.kind) for k in kinds)).alias(cells))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values are missing, by column."""
    counts = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_rows")) for c in columns]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))
