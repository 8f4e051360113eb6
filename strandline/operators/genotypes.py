"""Genotype likelihoods from amplified and sequenced samples: enumerate, simulate, score, marginalise.

A genotype gives each individual (with its ploidy) an allele per chromosome; a loading gives each
individual a number of genome copies.  Simulated copies of each allele are amplified and sequenced;
drawn reads are scored against an evaluation set of simulations of every (loading, genotype).

Draws meet the evaluation set in packed blocks: vectors of one (loading, class) are packed by some thousands, draws by some
hundreds, every pair of blocks is one row of a product of the two block tables, and a matrix product inside the task
scores it.  Nothing of either side is collected or has to fit a driver.

Random numbers are seeded by what is simulated (loading and genotype; draw), never by a batch or partition, so results do not
depend on how rows are dealt out or on tasks that run again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.prob import NEG_INF, log_sum_exp
from .aggregates import allele_loading, canonical_genotype, cumulative, winners

#: Vectors of a block of the evaluation set; draws of a block.
VECTORS, DRAWS = 4096, 256


@dataclass(frozen=True)
class Parameters:
    alleles: int
    load: int
    ploidies: tuple[int, ...]
    cycles: int = 0
    efficiency: float = 0.9
    error: float = 0.0
    max_react: int = -1  #: negative: no limit; 0: nothing is copied
    fan: int = 32
    seed: int = 1234
    stutter: tuple[float, float] | None = None  #: rates down and up, instead of ``error``

    def __post_init__(self):
        if self.alleles < 1 or self.load < 0 or not self.ploidies or min(self.ploidies) < 1:
            raise ValueError("alleles and ploidies must be positive, and the load not negative")
        if self.cycles < 0 or self.fan < 1:
            raise ValueError("cycles must not be negative and the fan must be positive")
        for p in (self.efficiency, self.error, *(self.stutter or ())):
            if not 0 <= p <= 1:
                raise ValueError("probabilities must lie in [0, 1]")

    @property
    def rows(self) -> int:
        """The fan, up to a multiple of 32."""
        return -(-self.fan // 32) * 32


def genotypes(spark: SparkSession, alleles: int, ploidies: Sequence[int]) -> DataFrame:
    """(geno_idx, alleles array<int>, class): all genotypes in odometer order, and the class of those that look alike."""
    h = sum(ploidies)
    digits = [F.pmod(F.floor(F.col("id") / float(alleles ** (h - 1 - k))), F.lit(alleles)).cast("int") for k in range(h)]
    every = spark.range(alleles**h).select(F.col("id").alias("geno_idx"), F.array(*digits).alias("alleles"))
    named = every.withColumn("canon", canonical_genotype(F.col("alleles"), ploidies))
    key = F.aggregate("canon", F.lit(0).cast("bigint"), lambda a, x: a * alleles + x)
    classes = sorted(_canonical_keys(alleles, ploidies))
    rank = F.array_position(F.array(*(F.lit(c).cast("bigint") for c in classes)), key) - 1
    return named.select("geno_idx", "alleles", rank.cast("int").alias("class"))


def _canonical_keys(alleles: int, ploidies: Sequence[int]) -> list[int]:
    from itertools import combinations_with_replacement

    keys = [0]
    for p in ploidies:
        one = [sum(a * alleles ** (p - 1 - k) for k, a in enumerate(c)) for c in combinations_with_replacement(range(alleles), p)]
        keys = [k * alleles**p + x for k in keys for x in one]
    return keys


def loadings(spark: SparkSession, load: int, ploidies: Sequence[int]) -> DataFrame:
    """(load_idx, load array<int>): copies by individual that use the whole load, largest first; equal ploidies don't rise."""
    df = spark.range(1).select(F.array().cast("array<int>").alias("load"))
    left = F.lit(load)
    for i, p in enumerate(ploidies):
        used = sum((F.get("load", F.lit(k)) * ploidies[k] for k in range(i)), F.lit(0))
        most = F.floor((left - used) / p).cast("int")
        before = [k for k in range(i) if ploidies[k] == p]
        if before:
            most = F.least(most, F.get("load", F.lit(before[-1])))
        df = df.select(F.explode(F.when(most >= 0, F.transform(F.sequence(F.lit(0), most), lambda n: F.concat("load", F.array(n.cast("int")))))).alias("load"))
    total = sum((F.get("load", F.lit(k)) * p for k, p in enumerate(ploidies)), F.lit(0))
    found = sorted((tuple(r.load) for r in df.filter(total == load).collect()), reverse=True)
    return spark.createDataFrame([(i, list(x)) for i, x in enumerate(found)], "load_idx int, load array<int>")


def mutation_matrix(p: Parameters) -> np.ndarray:
    """P(copy is j | template is i)."""
    n = p.alleles
    if p.stutter:
        down, up = p.stutter
        m = np.zeros((n, n))
        for i in range(n):
            if i:
                m[i, i - 1] = down
            if i + 1 < n:
                m[i, i + 1] = up
            m[i, i] = 1 - m[i].sum()
        return m
    return flat_errors(n, p.error)


def flat_errors(n: int, error: float) -> np.ndarray:
    m = np.full((n, n), error / max(1, n - 1))
    np.fill_diagonal(m, 1 - error if n > 1 else 1.0)
    return m


def amplify(counts: np.ndarray, p: Parameters, rng: np.random.Generator) -> np.ndarray:
    """Counts of the alleles after all cycles; rows are samples.

    In each cycle a template is copied with the efficiency times the share of reactant left, a copy may
    mutate, and copies use up reactant.
    """
    counts = counts.astype(np.int64).copy()
    matrix = mutation_matrix(p)
    left = np.full(len(counts), float(max(p.max_react, 0)))
    for _ in range(p.cycles):
        if p.max_react == 0:
            break
        share = left / p.max_react if p.max_react > 0 else np.ones(len(counts))
        copies = rng.binomial(counts, np.clip(p.efficiency * share, 0, 1)[:, None])
        for i in range(p.alleles):
            counts += rng.multinomial(copies[:, i], matrix[i])
        left = np.maximum(left - copies.sum(axis=1), 0)
    return counts


def simulate(spark: SparkSession, p: Parameters) -> DataFrame:
    """(load_idx, geno_idx, class, rep, counts array<bigint>): every loading, genotype and replicate, amplified.

    The replicates of a loading and genotype are one array in a task, with a generator of their own.
    """
    from .lookup import cross

    every = cross(genotypes(spark, p.alleles, p.ploidies), loadings(spark, p.load, p.ploidies))
    start = allele_loading(F.col("alleles"), F.col("load"), p.ploidies, p.alleles)
    cases = every.select("load_idx", "geno_idx", "class", start.alias("counts"))
    if p.cycles == 0:
        return cases.select("load_idx", "geno_idx", "class", F.explode(F.sequence(F.lit(0), F.lit(p.rows - 1))).alias("rep"), "counts")

    def run(batches):
        for pdf in batches:
            for load, geno, cls, counts in zip(pdf.load_idx, pdf.geno_idx, pdf["class"], pdf.counts, strict=True):
                rng = np.random.default_rng([p.seed, int(load), int(geno)])
                grown = amplify(np.tile(np.asarray(counts), (p.rows, 1)), p, rng)
                yield pd.DataFrame({"load_idx": load, "geno_idx": geno, "class": cls, "rep": np.arange(p.rows), "counts": grown.tolist()})

    parts = max(1, min(10_000, -(-p.alleles ** sum(p.ploidies) // 64)))
    return cases.repartition(parts, "load_idx", "geno_idx").mapInPandas(run, "load_idx int, geno_idx long, class int, rep int, counts array<long>")


def draw_shares(counts: Column, errors: np.ndarray) -> Column:
    """Probabilities of reading each allele: errors times shares of templates (equal without any)."""
    n = len(errors)
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    one = lambda i: sum((F.lit(float(errors[i, j])) * F.when(total == 0, 1.0 / n).otherwise(F.get(counts, F.lit(j)) / total) for j in range(n)), F.lit(0.0))
    return F.array(*(one(i) for i in range(n)))


def draw_cdf(counts: Column, errors: np.ndarray) -> Column:
    return cumulative(draw_shares(counts, errors))


def draw_reads(sims: DataFrame, n_alleles: int, error: float, read_bits: int, seed: int = 1) -> DataFrame:
    """For each simulation and each number of reads 2^read_bits, ..., 2, 1: reads by allele.

    Adds draw_id, n_reads and reads to the simulation's columns; draw_id counts loading, genotype, replicate and number of reads.
    """
    errors = flat_errors(n_alleles, error)
    halved = F.explode(F.transform(F.sequence(F.lit(read_bits), F.lit(0)), lambda b: F.pow(F.lit(2.0), b).cast("bigint")))
    rows = sims.select("load_idx", "geno_idx", "class", "rep", draw_shares(F.col("counts"), errors).alias("share"), halved.alias("n_reads"))
    last = sims.agg(F.max("geno_idx"), F.max("rep")).first()
    genos, reps = ((x or 0) + 1 for x in last)
    key = ((F.col("load_idx").cast("bigint") * genos + F.col("geno_idx")) * reps + F.col("rep")) * (read_bits + 1) + F.log2("n_reads").cast("bigint")
    rows = rows.select(key.alias("draw_id"), "load_idx", "geno_idx", "class", "rep", "n_reads", F.col("share").alias("reads"))

    def run(batches):
        for pdf in batches:
            reads = []
            for d, n, share in zip(pdf.draw_id, pdf.n_reads, pdf.reads, strict=True):
                share = np.asarray(share)
                reads.append(np.random.default_rng([seed, d & 0xFFFFFFFFFFFFFFFF]).multinomial(n, share / share.sum()).tolist())
            yield pdf.assign(reads=reads)

    schema = "draw_id long, load_idx int, geno_idx long, class int, rep int, n_reads long, reads array<long>"
    return rows.mapInPandas(run, schema)


def score_reads(draws: DataFrame, evaluation: DataFrame, n_alleles: int, error: float) -> DataFrame:
    """(draw_id, load_idx, class, log_p): log mean over replicates, and log sum over the genotypes of a class."""
    errors = flat_errors(n_alleles, error)
    logs = F.transform(draw_shares(F.col("counts"), errors), lambda x: F.when(x > 0, F.ln(x)).otherwise(F.lit(NEG_INF)))
    fan = evaluation.groupBy("load_idx", "geno_idx").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.max("n"), F.sum("n"), F.count(F.lit(1))).first()
    if fan[0] != fan[1]:
        raise ValueError("loadings and genotypes of an evaluation set need equally many replicates")
    salts = max(1, -(-(fan[2] or 0) // VECTORS))  # at least as many blocks as needed, whatever the cells
    vectors = evaluation.select("load_idx", "class", F.pmod(F.xxhash64("geno_idx", "rep"), F.lit(salts)).alias("salt"), logs.alias("v"))
    vectors = vectors.groupBy("load_idx", "class", "salt").agg(F.flatten(F.collect_list("v")).alias("logs"))
    buckets = max(1, -(-draws.count() // DRAWS))
    packed = draws.groupBy(F.pmod(F.xxhash64("draw_id"), F.lit(buckets)).alias("bucket")).agg(F.collect_list("draw_id").alias("ids"), F.flatten(F.collect_list("reads")).alias("reads"))

    def run(batches):
        for b in batches:
            for load, cls, v, ids, r in zip(*(b.column(c) for c in ("load_idx", "class", "logs", "ids", "reads")), strict=True):
                v = v.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_alleles)
                reads = r.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_alleles)
                impossible = ~np.isfinite(v)
                p = reads @ np.where(impossible, 0, v).T
                p[(reads @ impossible.T.astype(float)) > 0] = NEG_INF
                peak = p.max(axis=1)
                lift = np.where(np.isfinite(peak), peak, 0)
                with np.errstate(divide="ignore"):
                    out = np.log(np.exp(p - lift[:, None]).sum(axis=1)) + lift
                n = len(out)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array([load.as_py()] * n, pa.int32()), pa.array([cls.as_py()] * n, pa.int32()), pa.array(out)], names=["draw_id", "load_idx", "class", "p"])

    pairs = packed.select("ids", "reads").crossJoin(vectors.select("load_idx", "class", "logs"))
    parts = pairs.mapInArrow(run, "draw_id long, load_idx int, class int, p double")
    if salts > 1:
        parts = log_sum_exp(parts, ["draw_id", "load_idx", "class"], "p", "p")
    return parts.select("draw_id", "load_idx", "class", (F.col("p") - math.log(fan[0] or 1)).alias("log_p"))


def marginals(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """The answers by draw: joint, by loading, by class, and each given the other, right and best wrong.

    scores: (draw_id, load_idx, class, log_p); truth: (draw_id, load_idx, class).  All values are relative to
    the sum over all cells, and those given something relative to the sum over that.
    """
    true = truth.select("draw_id", F.col("load_idx").alias("true_load"), F.col("class").alias("true_class"))
    all_of = log_sum_exp(scores, ["draw_id"], "log_p", "total")
    s = scores.join(true, "draw_id").join(all_of, "draw_id")
    n = s.agg(F.max("class")).first()[0]
    width = (n if n is not None else 0) + 1
    joint = winners(s, ["draw_id", "true_load", "true_class", "total"], (F.col("load_idx") == F.col("true_load")) & (F.col("class") == F.col("true_class")), F.col("log_p"), F.col("load_idx") * width + F.col("class"))
    out = joint.select("draw_id", "true_load", "true_class", "total", (F.col("right_score") - F.col("total")).alias("ln_joint_right"), (F.col("wrong_score") - F.col("total")).alias("ln_joint_wrong"), F.when(F.col("wrong_index") < 0, -1).otherwise(F.floor(F.col("wrong_index") / width)).cast("int").alias("wrong_joint_load"), F.when(F.col("wrong_index") < 0, -1).otherwise(F.pmod("wrong_index", F.lit(width))).cast("int").alias("wrong_joint_class"))

    def part(rows: DataFrame, of: str, name: str, total: str | None) -> DataFrame:
        keys = ["draw_id", f"true_{'load' if of == 'load_idx' else 'class'}", of, "total"]
        summed = log_sum_exp(rows, keys, "log_p", "p")
        if total == "own":
            own = log_sum_exp(rows, ["draw_id"], "log_p", "own")
            summed = summed.join(own, "draw_id").drop("total").withColumnRenamed("own", "total")
        w = winners(summed, ["draw_id", "total"], F.col(of) == F.col(keys[1]), F.col("p"), F.col(of))
        less = lambda c: F.when(F.col("total") == NEG_INF, F.lit(NEG_INF)).otherwise(F.col(c) - F.col("total"))
        return w.select("draw_id", less("right_score").alias(f"ln_{name}_right"), less("wrong_score").alias(f"ln_{name}_wrong"), F.col("wrong_index").cast("int").alias(f"wrong_{name}"))

    s = s.select("draw_id", "load_idx", "class", "log_p", "true_load", "true_class", "total")
    given_load, given_class = s.filter("load_idx = true_load"), s.filter("class = true_class")
    for piece in (part(s, "load_idx", "load", None), part(s, "class", "class", None), part(given_load, "class", "class_given_load", "own"), part(given_class, "load_idx", "load_given_class", "own")):
        out = out.join(piece, "draw_id", "left")
    return out


def individual_marginals(scores: DataFrame, classes: DataFrame) -> DataFrame:
    """(draw_id, individual, genotype, log_p): sums over the classes that give an individual a genotype.

    classes: (class, individual, genotype), a small dimension.
    """
    return log_sum_exp(scores.join(classes, "class"), ["draw_id", "individual", "genotype"], "log_p", "log_p_individual")


def class_genotypes(genos: DataFrame, ploidies: Sequence[int]) -> DataFrame:
    """(class, individual, genotype): the sorted alleles of each individual in each class."""
    parts, at = [], 1
    for i, p in enumerate(ploidies):
        parts.append(F.struct(F.lit(i).alias("individual"), F.array_join(F.transform(F.array_sort(F.slice("alleles", at, p)), lambda x: x.cast("string")), "/").alias("genotype")))
        at += p
    return genos.select("class", F.explode(F.array(*parts)).alias("x")).select("class", "x.*").distinct()


def individual_answers(scores: DataFrame, truth: DataFrame, classes: DataFrame) -> DataFrame:
    """(draw_id, individual, wrong_genotype, ln_right, ln_wrong): of each individual the right genotype and the best wrong one.

    scores: (draw_id, load_idx, class, log_p); truth: (draw_id, class); classes: (class, individual, genotype).  Probabilities are relative to
    the sum over all cells; of equal wrong ones the first genotype in order counts.
    """
    total = log_sum_exp(scores, ["draw_id"], "log_p", "total")
    right = truth.select("draw_id", "class").join(classes.select("class", "individual", F.col("genotype").alias("true_genotype")), "class").drop("class")
    each = individual_marginals(scores, classes).join(right, ["draw_id", "individual"]).join(total, "draw_id")
    is_right = F.col("genotype") == F.col("true_genotype")
    wrong = F.min(F.when(~is_right & (F.col("log_p_individual") > NEG_INF), F.struct((-F.col("log_p_individual")).alias("s"), F.col("genotype").alias("g"))))
    found = each.groupBy("draw_id", "individual", "total").agg(F.max(F.when(is_right, F.col("log_p_individual"))).alias("r"), wrong.alias("w"))
    less = lambda c: F.when(F.col("total") == NEG_INF, F.lit(NEG_INF)).otherwise(F.coalesce(c, F.lit(NEG_INF)) - F.col("total"))
    return found.select("draw_id", "individual", F.col("w.g").alias("wrong_genotype"), less(F.col("r")).alias("ln_right"), less(-F.col("w.s")).alias("ln_wrong"))


def report(answers: DataFrame, draws: DataFrame, n_alleles: int, individuals: DataFrame | None = None, n_individuals: int = 0) -> DataFrame:
    """The report: read counts, right and wrong answers and their log probabilities, and the same for every individual, under the report's names.

    individuals: of ``individual_answers``.
    """
    rows = draws.select("draw_id", *(F.get("reads", F.lit(i)).alias(f"RC{i}") for i in range(n_alleles))).join(answers, "draw_id")
    names = {
        "true_load": "RightLoading", "true_class": "RightGenotype", "wrong_joint_load": "WrongJointLoading", "wrong_joint_class": "WrongJointGenotype",
        "wrong_load": "WrongLoading", "wrong_class": "WrongGenotype", "wrong_class_given_load": "WrongGenotype|Load", "wrong_load_given_class": "WrongLoading|Geno",
        "ln_joint_right": "lnPJointRight", "ln_joint_wrong": "lnPJointWrong", "ln_load_right": "lnPLoadRight", "ln_load_wrong": "lnPLoadWrong",
        "ln_class_right": "lnPGenoRight", "ln_class_wrong": "lnPGenoWrong", "ln_class_given_load_right": "lnPGenoRight|Load", "ln_class_given_load_wrong": "lnPGenoWrong|Load",
        "ln_load_given_class_right": "lnPLoadRight|Geno", "ln_load_given_class_wrong": "lnPLoadWrong|Geno",
    }
    columns = [*(F.col(f"RC{i}") for i in range(n_alleles)), *(F.col(a).alias(b) for a, b in names.items())]
    if individuals is not None:
        of = {"WrongG": "wrong_genotype", "lnPRightG": "ln_right", "lnPWrongG": "ln_wrong"}
        wide = individuals.groupBy("draw_id").agg(*(F.max(F.when(F.col("individual") == i, F.col(c))).alias(f"{n}{i}") for i in range(n_individuals) for n, c in of.items()))
        rows = rows.join(wide, "draw_id", "left")
        columns += [F.col(f"{n}{i}") for i in range(n_individuals) for n in of]
    return rows.select(*columns)
