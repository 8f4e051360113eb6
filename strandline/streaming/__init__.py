"""The text-table path over streams: the same expressions on an unbounded frame; folders of block files as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import rows, typed
from ..schema import ColumnKind
from ..sources import binary, reads, tables


def stream_tsv(spark: SparkSession, folder: str, escapes: bool = True, files_per_trigger: int | None = None) -> DataFrame:
    """Cells of the rows of every file that arrives in a folder."""
    source = spark.readStream.option("lineSep", "\n")
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    return rows.drop_empty(source.text(folder).select(tables.clean_line(F.col("value"), escapes).alias("cells")))


def stream_typed(spark: SparkSession, folder: str, kinds: list[ColumnKind], **options) -> DataFrame:
    """Typed columns of a stream of rows without header; a row of another width stops the query."""
    return typed.to_typed(stream_tsv(spark, folder, **options), kinds)


def stream_fasta(spark: SparkSession, folder: str, sink, checkpoint: str, files_per_trigger: int = 1000, available_now: bool = False):
    """Starts a query that gives the records of the new FASTA files of a batch to ``sink(df, batch)``.

    A batch that runs again after a failure has the same number, so a sink that replaces what it wrote for that number writes once.
    """
    source = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger)
    files = source.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def batch(df: DataFrame, number: int) -> None:
        paths = [row.path for row in df.collect()]  # at most files_per_trigger names
        if paths:
            sink(reads.read_fasta(df.sparkSession, paths), number)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_blocks(spark: SparkSession, folder: str, rows: int = 65_536, sets: int = 0, number: str | None = None) -> DataFrame:
    """The rows of every set that is committed to a folder of block files, of which there must be one; row numbers go on from batch to batch."""
    binary.register(spark)
    source = spark.readStream.format("strandline").option("rows", str(rows)).option("sets", str(sets))
    return (source.option("number", number) if number else source).load(folder)


def write_blocks(df: DataFrame, folder: str, suffix: str, checkpoint: str, stream: str = ""):
    """Starts a query that appends a set to a folder for each batch of a stream, once for each batch number of the named stream."""
    binary.register(df.sparkSession)
    writer = df.writeStream.format("strandline").option("suffix", suffix).option("stream", stream).option("checkpointLocation", checkpoint)
    return writer.start(folder)
