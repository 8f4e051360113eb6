"""Files of the genotype pipeline: simulated loadings and scored reads (numbers in the byte order of the machine)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import streams

#: Columns of a scored read between its read counts and those by individual; the first eight are whole numbers.
INDICES = ["RightLoading", "RightGenotype", "WrongJointLoading", "WrongJointGenotype", "WrongLoading", "WrongGenotype", "WrongGenotype|Load", "WrongLoading|Geno"]
NUMBERS = ["lnPJointRight", "lnPJointWrong", "lnPLoadRight", "lnPLoadWrong", "lnPGenoRight", "lnPGenoWrong", "lnPGenoRight|Load", "lnPGenoWrong|Load", "lnPLoadRight|Geno", "lnPLoadWrong|Geno"]


def read_loadings(spark: SparkSession, path: str) -> DataFrame:
    """(load_idx, geno_idx, rep, counts array<bigint>) of simulated loadings, by ranges of records."""
    return streams.read_fixed(spark, path, "loadings", "load_idx int, geno_idx long, rep int, counts array<long>")


def record(alleles: int, individuals: int) -> np.dtype:
    """The layout of a scored read."""
    whole = [f"RC{i}" for i in range(alleles)] + INDICES + [f"WrongG{i}" for i in range(individuals)]
    real = NUMBERS + [f"lnP{w}G{i}" for i in range(individuals) for w in ("Right", "Wrong")]
    return np.dtype([(c, "=i8") for c in whole] + [(c, "=f8") for c in real])


def pack_scored(rows: Iterable[tuple], alleles: int, individuals: int) -> bytes:
    """Records of scored reads, given in the order of the file."""
    return np.array(list(rows), dtype=record(alleles, individuals)).tobytes()


def read_scored(spark: SparkSession, path: str, alleles: int, individuals: int) -> DataFrame:
    """Scored reads under the names of the report; genotypes and loadings are numbers; -1 where there is none."""
    kind = record(alleles, individuals)
    schema = ", ".join(f"`{c}` {'long' if kind[c].kind == 'i' else 'double'}" for c in kind.names)
    return streams.read_fixed(spark, path, "scored", schema, alleles=alleles, individuals=individuals)
