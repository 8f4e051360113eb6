"""Suffix arrays of string columns, built by prefix doubling in NumPy and searched by expressions; and of all texts of a table joined, built by joins and sorts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def suffix_array(text: str) -> np.ndarray:
    """Starts of the suffixes in order of their code points."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    rank = np.unique(codes, return_inverse=True)[1]
    k = 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.append(0, np.cumsum(ordered[1:] != ordered[:-1]))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        k *= 2


@F.pandas_udf(T.ArrayType(T.LongType()))
def suffix_array_udf(s: pd.Series) -> pd.Series:
    return s.map(suffix_array, na_action="ignore")


def ranked_suffixes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, pos) of every suffix, from 0."""
    return df.select(key, F.posexplode(suffix_array_udf(text)).alias("rank", "pos")).select(key, F.col("rank").cast("bigint").alias("rank"), "pos")


def interval(suffixes: Column, text: Column, pattern: str) -> Column:
    """struct<from, to>: the run of suffix-array entries whose suffixes begin with the pattern, by two binary searches in the row."""
    head = lambda p: F.substring(text, (p + 1).cast("int"), F.lit(len(pattern)))
    size = F.size(suffixes)

    def first_without(below) -> Column:
        """The number of entries for which ``below`` holds; it holds for a prefix of the array."""

        def halve(s: Column, _: Column) -> Column:
            middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
            yes = below(head(F.get(suffixes, middle)))
            open_ = s["low"] < s["high"]
            return F.struct(F.when(open_ & yes, middle + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~yes, middle).otherwise(s["high"]).alias("high"))

        steps = F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int") + 1)
        return F.aggregate(steps, F.struct(F.lit(0).alias("low"), size.alias("high")), halve, lambda s: s["low"])

    return F.when(size > 0, F.struct(first_without(lambda h: h < pattern).alias("from"), first_without(lambda h: h <= pattern).alias("to"))).otherwise(F.struct(F.lit(0).alias("from"), F.lit(0).alias("to")))


class Search:
    """Narrows an interval of a suffix array one character at a time."""

    def __init__(self, text: str, order: np.ndarray | None = None):
        self.text = text
        self.order = suffix_array(text) if order is None else order
        self.begin, self.end, self.depth = 0, len(self.order), 0

    def limit(self, c: str) -> int:
        """Keep the suffixes whose next character is c; returns how many there are."""
        at = lambda i: self.text[self.order[i] + self.depth] if self.order[i] + self.depth < len(self.text) else ""
        low, high = self.begin, self.end
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if at(mid) < c else (low, mid)
        begin, high = low, self.end
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if at(mid) <= c else (low, mid)
        self.begin, self.end, self.depth = begin, low, self.depth + 1
        return self.end - self.begin


#: Code points of a batch of a text.
PIECE = 1 << 18


def joined_codes(df: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """(pos, code) of every character of all texts joined in order of their keys, each followed by the separator; null is empty.

    A text's place follows from sums over the sorted rows, within the files of a stored table and over these.
    """
    from ..sources.ordinals import numbered

    rows = numbered(df.select(key, F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(separator)).alias("t")).orderBy(key, "t"), "n")
    blocks = rows.groupBy(F.floor(F.col("n") / BLOCK).alias("b")).agg(F.sum(F.length("t")).alias("size"))
    base = blocks.select("b", (F.sum("size").over(Window.orderBy("b")) - F.col("size")).alias("base"))  # one row a block of texts
    within = F.sum(F.length("t")).over(Window.partitionBy("b").orderBy("n")) - F.length("t")
    placed = rows.withColumn("b", F.floor(F.col("n") / BLOCK)).withColumn("within", within).join(base, "b")

    def run(batches):
        for b in batches:
            for at, t in zip(b.column("at").to_pylist(), b.column("t").to_pylist(), strict=True):
                for i in range(0, len(t), PIECE):
                    codes = np.frombuffer(t[i : i + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at + i + np.arange(len(codes))), pa.array(codes)], names=["pos", "code"])

    return placed.select((F.col("base") + F.col("within")).alias("at"), "t").mapInArrow(run, "pos long, code long")


#: Texts whose sizes are summed together.
BLOCK = 10_000
#: A round looks at so many stretches of the length that is settled, so this grows to their sum.
STRETCHES = 4


def suffix_array_of(codes: DataFrame) -> DataFrame:
    """(rank, pos) of the suffixes of one text, a row a character (pos from 0, code), of any size.

    A suffix's rank is the number of suffixes whose first h characters are less.  A round takes the ranks of the suffixes h, 2h and 3h
    further on, by joins on the position, sorts those that still share a rank by all four, and gives each its rank within its group;
    so h grows fourfold, and suffixes that stand alone are not sorted again.  Ranks come from the places of rows in a stored sorted
    table, so no task holds more than its range.
    """
    from ..session import shared_path
    from ..sources.ordinals import numbered

    spark = codes.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = shared_path(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    ranks = stored(codes.select("pos", F.col("code").alias("rank")))
    tied, h = ranks.select("pos", F.lit(0).cast("bigint").alias("group"), F.col("rank").alias("r0")), 1
    while True:
        names = [f"r{k}" for k in range(STRETCHES)]
        wide = tied
        for k in range(1, STRETCHES):
            wide = wide.join(ranks.select((F.col("pos") - k * h).alias("pos"), F.col("rank").alias(f"r{k}")), "pos", "left")
        wide = wide.fillna(-1, names[1:])  # the text ends before
        ordered = numbered(wide.orderBy("group", *names), "at")
        first = ordered.groupBy("group", *names).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        base = first.groupBy("group").agg(F.min("first").alias("base"))
        place = first.join(base, "group").withColumn("rank", F.col("group") + F.col("first") - F.col("base"))
        told = stored(ordered.join(place, ["group", *names]).select("pos", "rank", "n"))
        rest = ranks.join(told.select("pos"), "pos", "left_anti") if h > 1 else None
        ranks = stored(told.select("pos", "rank") if rest is None else rest.unionByName(told.select("pos", "rank")))
        tied = told.filter("n > 1").select("pos", F.col("rank").alias("group"), F.col("rank").alias("r0"))
        if not tied.limit(1).count():
            return ranks.select("rank", "pos")
        h *= STRETCHES
