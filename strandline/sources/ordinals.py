"""Row numbers that follow the files: by name, then by place in the file, whatever the splits and the tasks that read them.

Spark packs the splits of several files into tasks by size, so neither the first row nor the order of partitions is that of the
files.  Here a first pass counts the rows of each split (one row a split is stored); sums of these counts in order of (file,
begin of the split) give each split's first number, to which a row adds its place in the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_path

#: Most splits whose sums are broadcast.
MAX_BROADCAST_SPLITS = 100_000
#: Where the number of the task begins in Spark's increasing numbers.
TASK_BITS = 33


def file_columns() -> tuple[Column, Column]:
    """The file and the begin of the split of each row that a file source reads."""
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")


def in_file_order(rows: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows (file, block, ...) with a number from 0 instead of file and block.

    rows must come straight from reading, filtering or mapping files, as a split's rows must stand in a task as they stand in the
    file.  Where a second reading deals the splits to other tasks than the first, the query stops with an error.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("__place", F.monotonically_increasing_id())
    path = shared_path(spark)
    placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__least")).write.parquet(path)
    splits = spark.read.parquet(path)
    order = Window.orderBy("file", "block")  # one row a split
    first = splits.select("file", "block", "__least", (F.sum("__n").over(order) - F.col("__n")).alias("__first"))
    first = F.broadcast(first) if splits.count() <= MAX_BROADCAST_SPLITS else first
    told = placed.join(first, ["file", "block"], "left")
    task = lambda c: F.shiftright(c, TASK_BITS)
    same = F.coalesce(task("__place") == task("__least"), F.lit(False))
    number = F.when(F.assert_true(same, F.lit("files were split otherwise than when they were counted")).isNull(), F.col("__first") + F.col("__place") - F.col("__least"))
    others = [c for c in rows.columns if c not in ("file", "block")]
    return told.select(number.alias(name), *others)


def first_of(rows: DataFrame):
    """The first row of a frame (file, block, ...) in that order, None if there is none.

    Mostly the begin of the first file has it, which is all that is read then.
    """
    for file in sorted(rows.inputFiles())[:2]:
        first = rows.filter((F.col("file") == file) & (F.col("block") == 0)).first()  # of one split, whose rows come in order
        if first is not None:
            return first
    placed = rows.withColumn("__place", F.monotonically_increasing_id())
    first = placed.agg(F.min_by(F.struct(*rows.columns), F.struct("file", "block", "__place")).alias("row")).first()
    return first.row


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Any rows numbered from 0 in the order of their partitions.

    They are stored, as a frame that is computed twice need not be dealt alike; then a row's number follows from its file's place
    among the files and its own place there.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    file = F.col("_metadata.file_path")
    part = F.regexp_extract(file, r"part-(\d+)-", 1).cast("bigint")
    rows = read.select(F.struct(*(read[c] for c in df.columns)).alias("__row"), part.alias("__part"), F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    counts = rows.groupBy("__part", "__file").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select("__part", "__file", (F.sum("__n").over(Window.orderBy("__part", "__file")) - F.col("__n")).alias("__first"))  # one row a file
    told = rows.join(F.broadcast(first) if counts.count() <= MAX_BROADCAST_SPLITS else first, ["__part", "__file"])
    return told.select((F.col("__first") + F.col("__at")).alias(name), "__row.*")
