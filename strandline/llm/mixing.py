"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

The rate of a source is its share of the target total divided by its number of documents.  Each
document draws its number of copies by inverting the Poisson distribution of that rate at a uniform
number taken from an MD5 of (seed, doc_id); the document is exploded by that number, and a hash of
(seed, doc_id, copy) deals the copies over the partitions and orders them there, so any two copies
may meet anywhere.  A rate above ``PART`` is drawn as a sum of equal Poisson parts with a hash each,
which keeps exp(-rate) and the table of cumulative probabilities small.

Edge cases: a null source is a source of its own; a source without a weight (or with one that is
null, NaN or not positive) gets no copy; weights of absent sources are ignored and the others are
scaled to one; a row with a null doc_id draws by the MD5 of its text instead; repeated rows draw alike; an empty table stays
empty.  Null, empty and very long texts pass through.  Only input columns named ``copy`` or ``rate`` are replaced; the
row travels as one struct, so no other name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .textkit import stored

#: Largest rate that is drawn in one part.
PART = 32.0
#: Most sources whose rates are broadcast (a rate row is below 2 kB); beyond, a salted join is used.
MAX_BROADCAST_SOURCES = 5_000
SALTS = 32
ADDED = ("copy", "rate")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _id(key: Column, text: Column) -> Column:
    return F.coalesce(key.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text.cast("binary"), F.lit("").cast("binary")))))


def source_rates(docs: DataFrame, weights: DataFrame, total: float | None, source: str = "source") -> DataFrame:
    """(source, n, rate, parts, cdf) of every source that gets copies; weights has (source, weight)."""
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    given = weights.select(F.col("source").alias("__given"), F.col("weight").cast("double").alias("__w"))
    given = given.filter(~F.isnan("__w") & (F.col("__w") > 0)).groupBy("__given").agg(F.sum("__w").alias("__w"))
    both = counts.join(given, F.col("__source").eqNullSafe(F.col("__given")))
    sums = both.agg(F.sum("__w").alias("__sum_w"))
    every = counts.agg(F.sum("__n").alias("__all")) if total is None else sums.select(F.lit(float(total)).alias("__all"))
    rated = both.crossJoin(F.broadcast(sums.crossJoin(every)))  # one row each
    rate = F.col("__w") / F.col("__sum_w") * F.col("__all") / F.col("__n")
    rated = rated.select("__source", "__n", rate.alias("__rate"))
    rated = rated.withColumn("__parts", F.greatest(F.ceil(F.col("__rate") / PART), F.lit(1)).cast("int"))
    part = F.col("__rate") / F.col("__parts")
    last = F.ceil(part + 12 * F.sqrt(part) + 40).cast("int")
    start = F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("cdf"))
    grow = lambda acc, k: F.struct(
        (acc["p"] * part / k).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * part / k)).alias("cdf"),
    )
    return rated.withColumn("__cdf", F.aggregate(F.sequence(F.lit(1), last), start, grow, lambda acc: acc["cdf"]))


def poisson_mix(
    docs: DataFrame,
    weights: DataFrame,
    total: float | None = None,
    seed: int = 17,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """Every document as often as it is drawn, in random order, with ``copy`` (1, 2, ...) and ``rate``.

    weights: (source, weight).  total: wanted number of rows, by default the number of documents.
    """
    return _drawn(docs.drop(*ADDED), weights, total, seed, key, source, text, partitions).select("_row.*", "copy", "rate")


def mixed_rows(docs: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """The same rows with all columns of the documents, whatever their names, and no others."""
    return _drawn(docs, weights, total, seed, "doc_id", "source", "text", None).select("_row.*")


def _drawn(docs: DataFrame, weights: DataFrame, total: float | None, seed: int, key: str, source: str, text: str, partitions: int | None) -> DataFrame:
    """(_row, copy, rate) in random order."""
    rates = stored(source_rates(docs, weights, total, source))
    field = lambda name: F.col("_row").getField(name)
    ident = _id(field(key), field(text) if text in docs.columns else F.lit(None))
    rows = docs.select(F.struct("*").alias("_row"))
    rows = rows.select("_row", ident.alias("__id"), field(source).alias("__of"))
    if rates.count() <= MAX_BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), F.col("__of").eqNullSafe(F.col("__source")))
    else:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
        spread = rates.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, (F.col("__salt") == F.col("__at")) & F.col("__of").eqNullSafe(F.col("__source")))
    drawn = lambda acc, j: acc + F.size(
        F.filter("__cdf", lambda c: c <= uniform(F.lit(str(seed)), j.cast("string"), F.col("__id")))
    )
    number = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), drawn)
    copies = joined.withColumn("__number", number).filter("__number > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__number").cast("bigint"))))
    # the row is part of the order, so that rows that share an id are dealt out too
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.xxhash64("_row").cast("string"), F.col("__id"), F.col("copy").cast("string")))
    out = copies.select("_row", "copy", F.col("__rate").alias("rate"), order.alias("__order"))
    dealt = out.repartition(partitions, "__order") if partitions else out.repartition("__order")
    return dealt.sortWithinPartitions("__order")


def root_weights(docs: DataFrame, source: str = "source") -> DataFrame:
    """Weights that flatten the sources: the square root of each source's number of documents."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sqrt(F.count(F.lit(1))).alias("weight"))
