"""Row operators: filters, projections, ranges, merges and bounds.  Order is data: it is a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def keep(df: DataFrame, test: Column) -> DataFrame:
    """Rows for which the test holds; a view, as nothing is computed before the plan runs."""
    return df.filter(test)


def mutate(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def drop_empty(df: DataFrame, cells: str = "cells") -> DataFrame:
    """Without rows of no cell or of one empty cell."""
    c = F.col(cells)
    return df.filter((F.size(c) > 1) | ((F.size(c) == 1) & (F.element_at(c, 1) != "")))


def row_range(df: DataFrame, first: int, stop: int, key: str = "row_id") -> DataFrame:
    """Rows [first, stop) by row number; a filter that prunes Parquet row groups."""
    if first > stop:
        raise ValueError("range ends before it begins")
    return df.filter((F.col(key) >= first) & (F.col(key) < stop))


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows after ``offset`` in an order that must be total."""
    ordered = df.orderBy(*order)
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def merge_sorted(a: DataFrame, b: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows of both, sorted; two sorted inputs merge to this whatever their partitions."""
    return a.unionByName(b).orderBy(*order)


def bounds(df: DataFrame, key: Column, probes: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """For each probe the number of keys below it and not above it: its lower and upper bound in the sorted rows."""
    counts = [
        F.struct(F.lit(float(p)).alias("probe"), F.count_if(key < F.lit(p)).alias("lower_bound"), F.count_if(key <= F.lit(p)).alias("upper_bound")) for p in probes
    ]
    found = df.groupBy(*by).agg(F.array(*counts).alias("b"))
    return found.select(*by, F.inline("b"))


#: Parts into which an interval of keys is cut in a round.
HISTOGRAM = 1024


def split_points(df: DataFrame, key: str, parts: int) -> list:
    """Keys that part the rows into ``parts`` runs of equal length, to one row and ties."""
    return [x for x, _, _ in split_places(df, key, parts)]


def split_places(df: DataFrame, key: str, parts: int) -> list[tuple]:
    """For k = 1 .. parts - 1 the key of row ceil(n k / parts) in order of the key, how many rows are less, and how many not greater.

    The keys are numbers; null and NaN keys are left out, infinite ones count as the last finite number.  Ranks are exact: each round counts the rows of ``HISTOGRAM`` parts of the
    intervals that hold the wanted ranks, and goes on in the parts that do, until such a part has a single key.  Equal keys
    cannot be parted, so a key may come more than once.  What reaches the driver is one row for each of these parts.
    """
    most = F.lit(1.7976931348623157e308)
    x = F.least(F.greatest(F.col(key).cast("double"), -most), most)
    t = df.filter(F.col(key).isNotNull() & ~F.isnan(F.col(key).cast("double"))).select(x.alias("x"))
    n, low, high = t.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return []
    #: k: (least key, greatest key, rows below the least key, rows between them)
    now = {k: (low, high, 0, n) for k in range(1, parts)}
    rank = {k: -(-n * k // parts) for k in now}
    while any(lo < hi for lo, hi, _, _ in now.values()):
        some = sorted({(lo, hi) for lo, hi, _, _ in now.values() if lo < hi})
        which = F.lit(None).cast("int")
        for i, (lo, hi) in enumerate(some):
            which = F.when(F.col("x").between(lo, hi), F.lit(i)).otherwise(which)
        lows, widths = (F.element_at(F.array(*map(F.lit, v)), F.col("i") + 1) for v in ([lo for lo, _ in some], [hi / 2 - lo / 2 for lo, hi in some]))
        part = F.least(F.when(widths > 0, F.floor((F.col("x") / 2 - lows / 2) / widths * HISTOGRAM)).when(F.col("x") > lows, 1).otherwise(0), F.lit(HISTOGRAM - 1))  # halves cannot overflow
        found = t.select("x", which.alias("i")).filter("i is not null").groupBy("i", part.alias("part")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        by = {}
        for r in sorted(found, key=lambda r: (r.i, r.low)):
            by.setdefault(some[r.i], []).append(r)
        for k, (lo, hi, below, _) in now.items():
            if lo < hi:
                for r in by[lo, hi]:
                    if below + r.n >= rank[k]:
                        break
                    below += r.n
                now[k] = (r.low, r.high, below, r.n)
    return [(lo, below, below + m) for lo, _, below, m in (now[k] for k in sorted(now))]


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows numbered from 0 in the order of their partitions."""
    from ..sources import ordinals

    return ordinals.numbered(df, name)
