"""Aggregates in log space, winners, proportions and canonical multisets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.prob import NEG_INF, log_sum_exp


def log_mean_exp(df: DataFrame, keys: Sequence[str], value: str, name: str = "log_mean") -> DataFrame:
    """ln of the mean of exp(value) over the rows of a group."""
    done = log_sum_exp(df, keys, value, "__lse", "__n")
    return done.select(*keys, (F.col("__lse") - F.ln("__n")).alias(name))


def winners(df: DataFrame, keys: Sequence[str], right: Column, score: Column, index: Column) -> DataFrame:
    """Of each group the score of the right answer, and the best wrong one; the lower index wins ties.

    Without a right or a wrong answer above minus infinity its score is minus infinity and its index -1.
    """
    wrong = F.min(F.when(~right & (score > NEG_INF), F.struct((-score).alias("s"), index.alias("i"))))
    return df.groupBy(*keys).agg(F.max(F.when(right, score)).alias("__right"), wrong.alias("__wrong")).select(
        *keys,
        F.coalesce("__right", F.lit(NEG_INF)).alias("right_score"),
        F.coalesce(-F.col("__wrong.s"), F.lit(NEG_INF)).alias("wrong_score"),
        F.coalesce("__wrong.i", F.lit(-1)).alias("wrong_index"),
    )


def best_two(df: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """Best and second best (score, tie) of a group; the lower tie wins.  Ranks above two are dropped before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie)))
    top = df.select(*keys, score, tie, rank.alias("__r")).filter("__r <= 2")
    at = lambda r, c: F.max(F.when(F.col("__r") == r, F.col(c)))
    return top.groupBy(*keys).agg(at(1, tie).alias("best_id"), at(1, score).alias("best_score"), at(2, tie).alias("second_id"), at(2, score).alias("second_score"))


def proportions(counts: Column) -> Column:
    """An array of counts as shares; without any count they are all equal."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total == 0, 1.0 / F.size(counts)).otherwise(x / total))


def cumulative(shares: Column) -> Column:
    """The running sums of an array divided by its sum."""
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shares, lambda _, i: F.aggregate(F.slice(shares, 1, i + 1), F.lit(0.0), lambda a, x: a + x) / total)


def allele_loading(alleles: Column, loads: Column, ploidies: Sequence[int], n_alleles: int) -> Column:
    """Copies of each allele: every allele of an individual adds the individual's load."""
    owner = [i for i, p in enumerate(ploidies) for _ in range(p)]
    one = lambda a: sum((F.when(F.get(alleles, F.lit(k)) == a, F.get(loads, F.lit(i))).otherwise(0) for k, i in enumerate(owner)), F.lit(0))
    return F.array(*(one(a).cast("bigint") for a in range(n_alleles)))


def loading_by_allele(df: DataFrame, keys: Sequence[str], allele: str, load: str, n_alleles: int) -> DataFrame:
    """(keys, allele, load) of every allele of a group, from a row for each copy, whatever the number of copies."""
    sums = [F.coalesce(F.sum(F.when(F.col(allele) == a, F.col(load))), F.lit(0)).cast("bigint") for a in range(n_alleles)]
    return df.groupBy(*keys).agg(F.array(*sums).alias("__sums")).select(*keys, F.posexplode("__sums").alias("__a", "load")).select(*keys, F.col("__a").cast("bigint").alias("allele"), "load")


def canonical_multiset(alleles: Column) -> Column:
    """All alleles of one individual, sorted, whatever their number."""
    return F.array_sort(alleles)


def canonical_genotype(alleles: Column, ploidies: Sequence[int]) -> Column:
    """Alleles sorted within each individual: equal for genotypes that cannot be told apart."""
    parts, at = [], 1
    for p in ploidies:
        parts.append(F.array_sort(F.slice(alleles, at, p)))
        at += p
    return F.concat(*parts)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
