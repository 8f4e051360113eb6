"""A Spark data source for the binary formats: a partition is a range of rows, so reading is random access in parallel.

    register(spark)
    spark.read.format("strandline").load("t.zlib.bctab")
    df.write.format("strandline").option("suffix", ".zlib.bctab").mode("append").save(folder)

    spark.readStream.format("strandline").load(folder)
    df.writeStream.format("strandline").option("suffix", ".zlib.bctab").start(folder)

Paths and URIs are opened by the executors (see ``store``), so they must lie where all of them reach.  A task writes its set of files into
a work folder of its own attempt; the driver moves the sets of the attempts that count into place when all are done, under
names that follow those of earlier writes, and takes the work folder away.  So a repeated or abandoned attempt leaves
nothing, ``append`` adds sets and ``overwrite`` replaces them.  A folder is read as all the sets in it, in order of name.

Filters that bound the row number (``row_id``, ``seq_id``, ``graph_id``, or the column that the option ``number`` adds to rows of fixed
width) choose the rows that are read at all.  Readers and writers work on Arrow batches.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..schema import from_struct, to_struct
from . import blocks, packing, store

SUFFIXES = (".raw.bctab", ".zlib.bctab", ".raw.bcdat", ".zlib.bcdat", ".bdat", ".bdat.gz", ".bdat.gzip", ".raw.bcseq", ".zlib.bcseq", ".raw.bsgrap", ".zlib.bsgrap", ".raw.bsalgn", ".zlib.bsalgn", ".sealed")
#: Begins the name of the note of a commit, which the time of the commit follows.
NOTE = "_set-"
#: Columns that hold the number of a row.
NUMBERS = {("row_id",), ("seq_id",), ("graph_id",)}
TEXT = "row_id long, cells array<string>"
SEQUENCES = "seq_id long, name string, seq string"
GRAPHS = (
    "graph_id long, name string, seq string, extra binary, contigs array<struct<size: bigint, pos: array<struct<ins_open: float, ins_ext: float, ins_close: float, "
    "del_open: float, del_ext: float, del_close: float, base: array<float>>>, tail: struct<ins_open: float, ins_ext: float, ins_close: float>>>, "
    "in_links array<struct<contig: bigint, link: bigint>>, out_links array<struct<link: bigint, contig: bigint, p: float>>, num_links bigint, suffix array<bigint>"
)
ALIGNMENTS = "read_index long, ref_index long, log_prob double, start_contig_ref long, start_index_ref long, start_contig_read long, start_index_read long, events array<struct<type: string, n: int>>"


def kind_of(path: str) -> str:
    for kind in ("bctab", "bcdat", "bcseq", "bsgrap", "bsalgn"):
        if path.endswith("." + kind):
            return kind
    if path.endswith((".bdat", ".bdat.gz", ".bdat.gzip")):
        return "bdat"
    if path.endswith(".sealed"):
        return "sealed"
    raise ValueError(f"no binary format has the suffix of {path}")


def files_of(path: str) -> list[str]:
    if not store.is_folder(path):
        return [path]
    return [store.join(path, f) for f in store.names_in(path) if f.endswith(SUFFIXES)]


def size_of(path: str) -> int:
    kind = kind_of(path)
    if kind == "bctab":
        return blocks.text_table_size(path)
    if kind == "bcseq":
        return blocks.text_table_size(path)  # the same index of names
    if kind == "bsgrap":
        return blocks.graph_shape(path)[4]
    if kind == "bsalgn":
        return blocks.alignments_size(path)
    return blocks.data_shape(path)[2]


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    stop: int
    before: int


class Reader(DataSourceReader):
    number: str | None = None

    def __init__(self, options: dict):
        self.files = files_of(options["path"])
        self.grain = int(options.get("rows", 65_536))
        self.first, self.stop = 0, 1 << 63  # row numbers that are wanted
        self.number = options.get("number")

    def pushFilters(self, filters):
        """Takes bounds on the row number; all filters are applied again by Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and (f.attribute in NUMBERS or f.attribute == (self.number,)) and isinstance(f.value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.stop = min(self.stop, f.value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self):
        out, before = [], 0
        for path in self.files:
            n = size_of(path)
            # a file that is unpacked whole is one task's
            grain = max(n, 1) if path.endswith((".gz", ".gzip")) else self.grain
            low, high = max(0, self.first - before), min(n, self.stop - before)
            out += [Rows(path, i, min(high, i + grain), before) for i in range(low, high, grain)]
            before += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, part: Rows):
        if not part.path:
            return
        kind = kind_of(part.path)
        if kind == "bctab":
            for at, cells in blocks.text_batches(part.path, part.first, part.stop):
                yield pa.RecordBatch.from_arrays([pa.array(at + part.before), cells], names=["row_id", "cells"])
        elif kind == "bcseq":
            for at, names, seqs in blocks.sequence_batches(part.path, part.first, part.stop):
                yield pa.RecordBatch.from_arrays([pa.array(at + part.before), names, seqs], names=["seq_id", "name", "seq"])
        elif kind == "bsgrap":
            for at, columns in packing.graph_batches(part.path, part.first, part.stop):
                names = ["graph_id", "name", "seq", "extra", "contigs", "in_links", "out_links", "num_links", "suffix"]
                yield pa.RecordBatch.from_arrays([pa.array(at + part.before), *columns], names=names)
        elif kind == "bsalgn":
            for at, columns in packing.alignment_batches(part.path, part.first, part.stop):
                yield self._numbered(at + part.before, columns, [*packing.ALIGNMENT.names[:-1], "events"])
        else:
            kinds, *_ = blocks.data_shape(part.path)
            for at, columns in blocks.data_batches(part.path, part.first, part.stop):
                yield self._numbered(at + part.before, columns, [k.name for k in kinds])

    def _numbered(self, at, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
        if self.number:
            columns, names = [pa.array(at), *columns], [self.number, *names]
        return pa.RecordBatch.from_arrays(columns, names=names)


@dataclass
class Done(WriterCommitMessage):
    folder: str
    rows: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.folder, self.suffix, self.schema, self.overwrite = options["path"], options.get("suffix", ".zlib.bctab"), schema, overwrite
        if self.suffix not in SUFFIXES:
            raise ValueError(f"unknown suffix {self.suffix}")
        store.system(self.folder)  # an unknown scheme is an error before anything is written
        self.name, self.bases = options.get("name", ""), options.get("bases", "ACGT")
        self.job = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.work = store.join(self.folder, f"_work-{self.job}")

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        folder = store.join(self.work, str(context.taskAttemptId()))
        store.make_folder(folder)
        path = store.join(folder, f"part-{self.job}-{context.partitionId():06d}{self.suffix}")
        kind = kind_of(path)
        if kind == "bsgrap":
            out = packing.Graphs(path, self.name, self.bases)
        elif kind == "sealed":
            out = packing.Bytes(path)
        elif kind == "bctab":
            out = packing.TextTable(path)
        elif kind == "bcseq":
            out = packing.Sequences(path)
        elif kind == "bsalgn":
            out = packing.Alignments(path)
        else:
            out = packing.Data(path, from_struct(self.schema))
        for batch in iterator:
            out.add(batch)
        out.close()
        return Done(folder, out.rows)

    def commit(self, messages):
        self._commit(messages, {})

    def _commit(self, messages, said: dict) -> None:
        """Moves the sets into place, then names them in a note, which readers of streams go by."""
        store.make_folder(self.folder)
        old = [f for f in store.names_in(self.folder) if not f.startswith("_work-")] if self.overwrite else []
        sets = []
        for done in messages:
            if done is not None:
                for f in store.names_in(done.folder):
                    store.move(store.join(done.folder, f), store.join(self.folder, f))
                    if f.endswith(SUFFIXES):
                        sets.append((f, done.rows))
        for f in old:
            store.remove(store.join(self.folder, f))
        note = {"sets": sorted(sets), **said}
        with store.open_out(store.join(self.folder, f"{NOTE}{time.time_ns():020d}-{self.job}")) as f:
            f.write(json.dumps(note).encode())
        self._clear(messages)

    def abort(self, messages):
        self._clear(messages)

    def _clear(self, messages) -> None:
        """Takes the work folders away; in a stream the tasks' writer need not be this one."""
        for work in {self.work, *(done.folder.rpartition("/")[0] for done in messages if done is not None)}:
            store.remove_folder(work)


class StreamWriter(Writer, DataSourceStreamArrowWriter):
    """Appends a set for each batch of a stream; a batch that comes again after a failure leaves the set that is there."""

    def __init__(self, options: dict, schema: T.StructType):
        super().__init__(options, schema, False)
        self.stream = options.get("stream", "")

    def commit(self, messages, batchId):
        if any((n.get("stream"), n.get("batch")) == (self.stream, batchId) for _, n in notes_in(self.folder)):
            self._clear(messages)
        else:
            self._commit(messages, {"stream": self.stream, "batch": batchId})

    def abort(self, messages, batchId):
        self._clear(messages)


def notes_in(folder: str, after: str = "") -> list[tuple[str, dict]]:
    """Names and contents of a folder's notes in order of commit, those after a name."""
    out = []
    for name in store.names_in(folder) if store.is_folder(folder) else []:
        if name.startswith(NOTE) and name > after:
            with store.open_in(store.join(folder, name)) as f:
                out.append((name, json.loads(f.read())))
    return out


class StreamReader(DataSourceStreamReader):
    """The sets that are committed to a folder, in order of commit; an offset is the last note and the rows up to it.

    Row numbers go on from batch to batch.  ``sets`` bounds the commits of a batch (all that are there, if it is 0).
    """

    def __init__(self, options: dict):
        self.folder, self.number = options["path"], options.get("number")
        self.grain, self.most = int(options.get("rows", 65_536)), int(options.get("sets", 0))
        self.last = self.initialOffset()

    def initialOffset(self):
        return {"note": "", "rows": 0}

    def latestOffset(self):
        found = notes_in(self.folder, self.last["note"])
        for name, note in found[: self.most or None]:
            self.last = {"note": name, "rows": self.last["rows"] + sum(n for _, n in note["sets"])}
        return self.last

    def partitions(self, start, end):
        out, before = [], start["rows"]
        self.last = max(self.last, end, key=lambda o: o["note"])
        for name, note in notes_in(self.folder, start["note"]):
            if name > end["note"]:
                break
            for file, n in note["sets"]:
                path = store.join(self.folder, file)
                grain = max(n, 1) if file.endswith((".gz", ".gzip")) else self.grain
                out += [Rows(path, i, min(n, i + grain), before) for i in range(0, n, grain)]
                before += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, part: Rows):
        reader = Reader.__new__(Reader)
        reader.number = self.number
        yield from reader.read(part)

    def commit(self, end):
        pass  # sets stay where they are


class Strandline(DataSource):
    @classmethod
    def name(cls):
        return "strandline"

    def schema(self):
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no file with a known suffix in {self.options['path']}")
        kind = kind_of(files[0])
        number = self.options.get("number")
        if kind in ("bdat", "bcdat"):
            own = to_struct(blocks.data_shape(files[0])[0])
            if number in own.names:
                raise ValueError(f"the table has a column {number}")
            return T.StructType([T.StructField(number, T.LongType()), *own.fields]) if number else own
        if kind == "bsalgn" and number:
            return f"`{number}` long, {ALIGNMENTS}"
        return {"bctab": TEXT, "bcseq": SEQUENCES, "bsgrap": GRAPHS, "bsalgn": ALIGNMENTS}[kind]

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, schema, overwrite)

    def streamReader(self, schema):
        return StreamReader(self.options)

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Strandline)


def read(spark: SparkSession, path: str, rows: int = 65_536, number: str | None = None):
    """Rows of a file or folder.  ``number`` names a column for the row's number in tables of typed columns and in alignments, whose
    rows have a fixed width; bounds on it choose the rows that are read."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("strandline").option("rows", str(rows))
    return (reader.option("number", number) if number else reader).load(path)


def write(df, folder: str, suffix: str, mode: str = "append", **options: str) -> None:
    register(df.sparkSession)
    df.write.format("strandline").options(suffix=suffix, **options).mode(mode).save(folder)
