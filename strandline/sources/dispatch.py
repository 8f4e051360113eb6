"""Sources and sinks by the suffix of a path, and data sets of processes and standard input."""

from __future__ import annotations

import collections
import shlex
import subprocess
import threading

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import binary, reads, tables

TABLE_SUFFIXES = (".tsv", ".tsv.gz", ".tsv.gzip", ".raw.bctab", ".zlib.bctab")
DATA_SUFFIXES = (".bdat", ".bdat.gz", ".bdat.gzip", ".raw.bcdat", ".zlib.bcdat")
SEQUENCE_SUFFIXES = (".fasta", ".fa", ".fasta.gz", ".fa.gz", ".fasta.gzip", ".fa.gzip", ".raw.bcseq", ".zlib.bcseq")
READ_SUFFIXES = (".fastq", ".fq", ".fastq.gz", ".fq.gz", ".fastq.gzip", ".fq.gzip")
GRAPH_SUFFIXES = (".raw.bsgrap", ".zlib.bsgrap")


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of text cells; ``-`` or nothing is standard input; unknown suffixes are plain text."""
    if path in ("", "-"):
        lines = tables.read_lines(spark)
        return tables.rows.drop_empty(lines.select(tables.clean_line(F.col("value")).alias("cells")))
    if path.endswith(".bctab"):
        return binary.read(spark, path).select("cells")
    return tables.read_tsv(spark, path)


def save_table(df: DataFrame, path: str) -> None:
    if path.endswith(".bctab"):
        binary.write(df.select("cells"), path, _suffix(path, TABLE_SUFFIXES))
    else:
        tables.write_tsv(df, path, compression="gzip" if path.endswith((".gz", ".gzip")) else None)


def open_data(spark: SparkSession, path: str) -> DataFrame:
    """Typed columns from a binary table, or from Parquet with the kinds in its metadata."""
    if path.endswith(DATA_SUFFIXES):
        return binary.read(spark, path)
    return spark.read.parquet(path)


def save_data(df: DataFrame, path: str) -> None:
    if path.endswith(DATA_SUFFIXES):
        binary.write(df, path, _suffix(path, DATA_SUFFIXES))
    else:
        df.write.parquet(path)


def open_sequences(spark: SparkSession, path: str) -> DataFrame:
    return binary.read(spark, path) if path.endswith(".bcseq") else reads.read_fasta(spark, path)


def save_sequences(df: DataFrame, path: str) -> None:
    if path.endswith(".bcseq"):
        binary.write(df.select("name", "seq"), path, _suffix(path, SEQUENCE_SUFFIXES))
    else:
        reads.write_fasta(df, path, "gzip" if path.endswith((".gz", ".gzip")) else None)


def open_reads(spark: SparkSession, path: str) -> DataFrame:
    return reads.read_fastq(spark, path)


def save_reads(df: DataFrame, path: str) -> None:
    reads.write_fastq(df, path, "gzip" if path.endswith((".gz", ".gzip")) else None)


def open_graphs(spark: SparkSession, path: str) -> DataFrame:
    return binary.read(spark, path) if path.endswith(".bsgrap") else spark.read.parquet(path)


def save_graphs(df: DataFrame, path: str, name: str = "", bases: str = "ACGT") -> None:
    if path.endswith(".bsgrap"):
        binary.write(df, path, _suffix(path, GRAPH_SUFFIXES), name=name, bases=bases)
    else:
        df.write.parquet(path)


def _suffix(path: str, known: tuple[str, ...]) -> str:
    for s in sorted(known, key=len, reverse=True):
        if path.endswith(s):
            return s
    raise ValueError(f"unknown suffix of {path}")


def open_process(spark: SparkSession, command: str, lines: DataFrame | None = None) -> DataFrame:
    """(value) of the lines that a program prints; given lines are its input, one process a partition.

    A program that ends with another code than 0 fails the task with the end of what it wrote to its standard error.
    """
    source = lines.select(F.col(lines.columns[0]).cast("string").alias("value")) if lines is not None else spark.range(1, numPartitions=1).select(F.lit(None).cast("string").alias("value"))
    return source.mapInArrow(lambda batches: _piped(command, batches), "value string")


def _piped(command: str, batches):
    """What a program prints for the values of some batches, which it is given while its output is read."""
    process = subprocess.Popen(shlex.split(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    failed: list[BaseException] = []
    said = collections.deque(maxlen=64)

    def feed():
        try:
            for b in batches:
                process.stdin.write("".join(f"{v}\n" for v in b.column("value").to_pylist() if v is not None).encode())
            process.stdin.close()
        except BrokenPipeError:  # it has read enough
            pass
        except BaseException as e:  # noqa: BLE001  raised again by the reader of the output
            failed.append(e)
            process.kill()

    def listen():
        while piece := process.stderr.read1(1 << 10):
            said.append(piece)

    others = [threading.Thread(target=f, daemon=True) for f in (feed, listen)]
    for t in others:
        t.start()
    try:
        while held := process.stdout.readlines(1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace").removesuffix("\n") for x in held], pa.string())], names=["value"])
        code = process.wait()
        for t in others:
            t.join()
    finally:
        process.kill()
    if failed:
        raise failed[0]
    if code:
        raise RuntimeError(f"{command} ended with code {code}: {b''.join(said).decode('utf-8', 'replace')}")


def discard(df: DataFrame) -> None:
    """Runs the plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
