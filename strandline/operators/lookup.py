"""Join-shaped operators: dimensions, factor codes, cross products, matrix products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .rows import numbered

#: Most rows of a dimension that is broadcast; beyond, the planner chooses the join.
MAX_BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a bounded count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(df: DataFrame, dim: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """Codes to texts; a code without a text gives null."""
    return df.join(small(dim), on, how)


def levels(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """The sorted distinct values of a column with codes from 0.

    The values are sorted by ranges and numbered from the sizes of the ranges, so no task gets all of them.
    """
    distinct = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return numbered(distinct.orderBy(column), name).select(column, name)


def encode_factor(df: DataFrame, column: str, dim: DataFrame, name: str = "code") -> DataFrame:
    """With the codes of a factor; unknown levels are missing."""
    return lookup(df, dim.select(column, name), column)


def decode_factor(df: DataFrame, code: str, dim: DataFrame, column: str) -> DataFrame:
    """With the levels of codes; an unknown code is an error."""
    joined = lookup(df, dim.select(code, column), code)
    bad = F.assert_true(F.col(code).isNull() | F.col(column).isNotNull(), F.concat(F.lit("unknown code "), F.col(code).cast("string")))
    return joined.withColumn(column, F.when(bad.isNull(), F.col(column)))


def level_code(c: Column, codes: dict[str, int]) -> Column:
    """Codes of a factor with few levels, as a literal map."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.element_at(F.create_map(*pairs), c) if pairs else F.lit(None).cast("int")


def cross(*frames: DataFrame) -> DataFrame:
    """Every combination of rows of small parameter tables; the first may be large."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(small(f))
    return out


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of coordinate matrices (i, j, v): an equi-join on the inner index and a sum."""
    left = a.select("i", F.col("j").alias("__k"), F.col("v").alias("__a"))
    right = b.select(F.col("i").alias("__k"), "j", F.col("v").alias("__b"))
    return left.join(right, "__k").groupBy("i", "j").agg(F.sum(F.col("__a") * F.col("__b")).alias("v"))
