"""Log-space sums, special functions and distributions.

Minus infinity is a legal log probability; Spark's ``ln(0)`` is null, so ``log_of`` guards it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

NEG_INF = float("-inf")


def log_of(c: Column) -> Column:
    """ln, with minus infinity at 0."""
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(NEG_INF))


#: Width of the ranges of logarithms that are summed together; exp of it is far from overflow.
RANGE = 64


def log_sum_exp(df: DataFrame, keys: Sequence[str], value: str, name: str = "lse", count: str | None = None) -> DataFrame:
    """ln of the sum of exp(value) by keys, and under ``count`` the number of values.

    One pass: values are summed by range, relative to its lower end, and the few ranges of a group are put together relative
    to the highest.  Groups whose values are all minus infinity or null give minus infinity.
    """
    x = F.col(value)
    finite = x > NEG_INF
    low = F.floor(x / RANGE).cast("double")
    ranges = df.groupBy(*keys, F.when(finite, low).alias("__b")).agg(F.sum(F.when(finite, F.exp(x - low * RANGE))).alias("__s"), F.count(value).alias("__n"))
    found = ranges.groupBy(*keys).agg(F.max("__b").alias("__top"), F.collect_list(F.when(F.col("__b").isNotNull(), F.struct("__b", "__s"))).alias("__r"), F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"))
    total = F.aggregate("__r", F.lit(0.0), lambda acc, r: acc + r["__s"] * F.exp((r["__b"] - F.col("__top")) * RANGE))
    lse = F.when(F.col("__top").isNull(), F.lit(NEG_INF)).otherwise(F.col("__top") * RANGE + F.ln(total))
    return found.select(*keys, lse.alias(name), *([F.col("__n").alias(count)] if count else []))


def lse_pair(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b)), the mergeable step."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(high == NEG_INF, F.lit(NEG_INF)).otherwise(high + F.log1p(F.exp(low - high)))


def lse_array(values: Column) -> Column:
    """ln of the sum of exp over an array; an empty one gives minus infinity."""
    peak = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - peak))
    return F.when((F.size(values) <= 0) | (peak == NEG_INF), F.lit(NEG_INF)).otherwise(peak + F.ln(total))


def log_one_minus_exp(c: Column) -> Column:
    """ln(1 - exp(c)) for c < 0, by whichever form keeps its digits."""
    return F.when(c == 0, F.lit(NEG_INF)).when(c > -0.693, F.ln(-F.expm1(c))).otherwise(F.log1p(-F.exp(c)))


#: Lanczos coefficients for g = 7 and nine terms.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(c: Column) -> Column:
    """ln of the absolute gamma function, as an expression; infinity at 0 and the negative whole numbers."""

    def lanczos(x: Column) -> Column:
        y = x - 1
        total = F.lit(LANCZOS[0])
        for k, a in enumerate(LANCZOS[1:], 1):
            total = total + a / (y + k)
        t = y + 7.5
        return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.ln(t) - t + F.ln(total)

    # the sine of the distance to the next whole number keeps its digits for large negative numbers
    reflected = F.lit(math.log(math.pi)) - F.ln(F.abs(F.sin(F.lit(math.pi) * (c - F.round(c))))) - lanczos(1 - c)
    return F.when(c >= 0.5, lanczos(c)).when((c <= 0) & (c == F.floor(c)), F.lit(float("inf"))).otherwise(reflected)


@F.pandas_udf(T.DoubleType())
def erf(c: pd.Series) -> pd.Series:
    """The error function (Arrow batches; Spark has none of its own)."""
    return c.map(math.erf, na_action="ignore")


def erf_approximate(c: Column) -> Column:
    """The error function to about 1.5e-7, as an expression (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(c)
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(c) * (1 - poly * F.exp(-x * x))


def _inverse_erf(y: float) -> float:
    from statistics import NormalDist

    if y != y or abs(y) > 1:
        return math.nan
    if abs(y) == 1:
        return math.copysign(math.inf, y)
    return NormalDist().inv_cdf((y + 1) / 2) / math.sqrt(2)


@F.pandas_udf(T.DoubleType())
def erf_inverse(c: pd.Series) -> pd.Series:
    """The inverse error function; beyond [-1, 1] there is none, and it is null (Arrow batches)."""
    return c.map(lambda v: None if v is None else _inverse_erf(v))


class Distribution:
    """Something with a density: ``log_pdf`` over columns, ``draw`` in NumPy, ``bounds`` that hold a probability, ``marginal``."""

    def log_pdf(self, *columns: Column) -> Column:
        raise NotImplementedError

    def draw(self, n: int, rng: np.random.Generator) -> np.ndarray:
        raise NotImplementedError

    def bounds(self, probability: float) -> list[tuple[float, float]]:
        raise NotImplementedError

    def marginal(self, keep: Sequence[int]) -> Distribution:
        raise NotImplementedError


@dataclass
class Uniform(Distribution):
    """On a box, closed below and open above."""

    low: Sequence[float]
    high: Sequence[float]

    def __post_init__(self):
        if len(self.low) != len(self.high) or any(a >= b for a, b in zip(self.low, self.high, strict=True)):
            raise ValueError("a box needs low < high in every dimension")

    def log_pdf(self, *columns):
        inside = F.lit(True)
        for c, a, b in zip(columns, self.low, self.high, strict=True):
            inside = inside & (c >= a) & (c < b)
        return F.when(inside, F.lit(-sum(math.log(b - a) for a, b in zip(self.low, self.high, strict=True)))).otherwise(F.lit(NEG_INF))

    def draw(self, n, rng):
        return rng.uniform(self.low, self.high, (n, len(self.low)))

    def bounds(self, probability):
        return list(zip(self.low, self.high, strict=True))

    def marginal(self, keep):
        return Uniform([self.low[i] for i in keep], [self.high[i] for i in keep])


@dataclass
class Gaussian(Distribution):
    mean: Sequence[float]
    cov: Sequence[Sequence[float]]

    def log_pdf(self, *columns):
        cov = np.asarray(self.cov, dtype=float)
        inverse = np.linalg.inv(cov)
        d = [c - float(m) for c, m in zip(columns, self.mean, strict=True)]
        square = F.lit(0.0)
        for i in range(len(d)):
            for j in range(len(d)):
                square = square + float(inverse[i, j]) * d[i] * d[j]
        log_det = 2 * np.log(np.diag(np.linalg.cholesky(cov))).sum()
        return -0.5 * square - float(0.5 * (len(d) * math.log(2 * math.pi) + log_det))

    def draw(self, n, rng):
        return np.asarray(self.mean) + rng.standard_normal((n, len(self.mean))) @ np.linalg.cholesky(np.asarray(self.cov, dtype=float)).T

    def bounds(self, probability):
        """The mean and as many deviations (of the widest direction) on both sides as hold the probability in one dimension."""
        if not 0 < probability < 1:
            raise ValueError("probability must lie between 0 and 1")
        reach = math.sqrt(2) * _inverse_erf(probability) * math.sqrt(float(np.linalg.eigvalsh(np.asarray(self.cov, dtype=float)).max()))
        return [(m - reach, m + reach) for m in self.mean]

    def marginal(self, keep):
        return Gaussian([self.mean[i] for i in keep], [[self.cov[i][j] for j in keep] for i in keep])


@dataclass
class Mixture(Distribution):
    """Components with log weights; the first added has 0 and the others minus infinity until set."""

    components: list[Distribution] = field(default_factory=list)
    log_weights: list[float] = field(default_factory=list)

    def add(self, component: Distribution) -> int:
        self.components.append(component)
        self.log_weights.append(NEG_INF if self.log_weights else 0.0)
        return len(self.components) - 1

    def set_weights(self, weights: Sequence[float]) -> None:
        if len(weights) != len(self.components) or min(weights) < 0 or abs(sum(weights) - 1) > 1e-9:
            raise ValueError("weights must be as many as components, not negative, and sum to one")
        self.log_weights = [math.log(w) if w > 0 else NEG_INF for w in weights]

    def _used(self):
        return [(w, c) for w, c in zip(self.log_weights, self.components, strict=True) if w > NEG_INF]

    def log_pdf(self, *columns):
        return lse_array(F.array(*(F.lit(w) + c.log_pdf(*columns) for w, c in self._used())))

    def draw(self, n, rng):
        used = self._used()
        pick = rng.choice(len(used), n, p=np.exp([w for w, _ in used]))
        drawn = np.stack([c.draw(n, rng) for _, c in used])
        return drawn[pick, np.arange(n)]

    def bounds(self, probability):
        boxes = [c.bounds(probability) for _, c in self._used()]
        return [(min(b[i][0] for b in boxes), max(b[i][1] for b in boxes)) for i in range(len(boxes[0]))]

    def marginal(self, keep):
        return Mixture([c.marginal(keep) for c in self.components], list(self.log_weights))


def draws(spark, distribution: Distribution, n: int, seed: int = 0, partitions: int = 8, block: int = 4096) -> DataFrame:
    """n draws as (id, x array<double>); every ``block`` of ids has a generator of its own, whatever task makes it."""

    def run(batches):
        for pdf in batches:
            for k in pdf.id:
                size = int(min(block, n - k * block))
                rng = np.random.default_rng([seed, int(k)])
                yield pd.DataFrame({"id": np.arange(k * block, k * block + size), "x": distribution.draw(size, rng).tolist()})

    return spark.range(0, -(-n // block), 1, partitions).mapInPandas(run, "id long, x array<double>")
