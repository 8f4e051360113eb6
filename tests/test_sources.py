import gzip
import io
import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.functions import text
from strandline.operators import rows, sequences, typed
from strandline.schema import ColumnKind, from_struct, kinds_of_header, parse_sigil, render_sigil
from strandline.sources import binary, blocks, dispatch, packing, reads, store, streams, tables
from strandline.streaming import stream_typed

KINDS = [ColumnKind("temp", "cat", {"cold": 0, "hot": 1}), ColumnKind("count", "int"), ColumnKind("score", "real"), ColumnKind("tag", "str", length=8)]
HEADER = "ccold\x1fhot:temp\ti:count\tr:score\ts8:tag\n"


def test_sigils():
    assert [parse_sigil(c) for c in HEADER.strip("\n").split("\t")] == KINDS
    assert "\t".join(map(render_sigil, KINDS)) + "\n" == HEADER
    for bad in ("", "count", "ca\x1f:x", "ca\x1fa:x", "s:x", "s0:x", "ix:y", "q:z"):
        with pytest.raises(ValueError):
            parse_sigil(bad)
    assert [(k.name, k.kind, k.length) for k in kinds_of_header(["a", "b"], head=True, sigil=False)] == [("a", "str", 256), ("b", "str", 256)]
    assert [k.name for k in kinds_of_header(["a", "b"], head=False)] == ["data0", "data1"]


def test_tsv_cells(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text(" a \\t\tb\\\\n\\x\r\n\n\t\nlast\\ \tone", encoding="utf-8")
    got = sorted(r.cells for r in tables.read_tsv(spark, str(path)).collect())
    assert got == sorted([["a \t", "b\\nx"], ["", ""], ["last ", "one"]])


def test_escape_undoes_unescape(spark):
    cells = ["", " ", "a b", " lead", "trail \t", "in\tside\nand\r", "\t x \n ", "é ü"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(text.unescape(text.trim_escaped(text.escape(F.col("c"))))).collect()]
    assert got == cells


def test_typed_reading(spark, tmp_path):
    path = tmp_path / "t.tsv.gz"
    body = HEADER + "cold\t12\t1.5e3\tabc\n warm \t1-2\tnan\t\nhot\t-7\t.\tlonger than eight\n"
    path.write_bytes(gzip.compress(body.encode()))
    df = tables.read_typed(spark, str(path))
    assert from_struct(df.schema) == KINDS
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("cold", 12, 1500.0, "abc"), (None, None, None, None), ("hot", -7, None, None)], key=str)
    (tmp_path / "bad.tsv").write_text(HEADER + "cold\t1\n")
    with pytest.raises(Exception, match="number of cells"):
        tables.read_typed(spark, str(tmp_path / "bad.tsv")).collect()


def test_gzip_suffix_and_writing(spark, tmp_path):
    (tmp_path / "x.tsv.gzip").write_bytes(gzip.compress(b"a\tb\nc\n"))
    df = dispatch.open_table(spark, str(tmp_path / "x.tsv.gzip"))
    assert sorted(r.cells for r in df.collect()) == [["a", "b"], ["c"]]
    dispatch.save_table(df, str(tmp_path / "out.tsv.gz"))
    assert sorted(r.cells for r in dispatch.open_table(spark, str(tmp_path / "out.tsv.gz")).collect()) == [["a", "b"], ["c"]]


@pytest.mark.parametrize("suffix", [".raw.bctab", ".zlib.bctab"])
def test_block_tables(spark, tmp_path, suffix):
    rows = [[], ["x"], ["", "é", "y" * 70_000], ["1", "2", "3", "4", "5"]] * 50
    path = str(tmp_path / ("t" + suffix))
    assert blocks.write_text_table(path, [[c.encode() for c in r] for r in rows]) == 200
    assert [[c.decode() for c in cells] for _, cells in blocks.read_text_table(path, 3, 9)] == rows[3:9]
    df = binary.read(spark, path, rows=64)
    assert df.rdd.getNumPartitions() == 4
    assert [r.cells for r in df.orderBy("row_id").collect()] == rows
    assert blocks.BlockReader(path, blocks.codec_of(path)).size() == sum(8 + sum(8 + len(c.encode()) for c in r) for r in rows)
    out = str(tmp_path / ("copy" + suffix))
    dispatch.save_table(df, out)
    assert sorted(r.cells for r in dispatch.open_table(spark, out).collect()) == sorted(rows)
    with open(path + ".blk", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        blocks.BlockReader(path, "raw")


@pytest.mark.parametrize("suffix", [".bdat", ".bdat.gz", ".raw.bcdat", ".zlib.bcdat"])
def test_binary_data(spark, tmp_path, suffix):
    values = [("cold", 1, 0.5, "ab"), (None, None, None, None), ("hot", -(1 << 62), -1e300, "12345678")]
    path = str(tmp_path / ("d" + suffix))
    blocks.write_data(path, KINDS, [list(v) for v in values])
    df = dispatch.open_data(spark, path)
    assert from_struct(df.schema) == KINDS and [tuple(r) for r in df.collect()] == values
    out = str(tmp_path / ("copy" + suffix))
    dispatch.save_data(df.coalesce(1), out)
    assert [tuple(r) for r in dispatch.open_data(spark, out).collect()] == values
    if suffix == ".bdat":
        data = open(path, "rb").read()
        (tmp_path / "cut.bdat").write_bytes(data[:-1])
        with pytest.raises(ValueError):
            blocks.data_shape(str(tmp_path / "cut.bdat"))
        (tmp_path / "type.bdat").write_bytes(data[:8] + b"\x05" + data[9:])
        with pytest.raises(ValueError):
            blocks.data_shape(str(tmp_path / "type.bdat"))


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("junk\n>one two \nAC GT\n\tA\r\n>empty\n>last\nTT")
    got = sorted((r.name, r.seq) for r in dispatch.open_sequences(spark, str(tmp_path / "a.fasta")).collect())
    assert got == [("empty", ""), ("last", "TT"), ("one two", "ACGTA")]
    (tmp_path / "many").mkdir()
    for k in range(5):  # small files share a partition
        (tmp_path / "many" / f"{k}.fa").write_text(f"{'' if k % 2 else 'junk'}\n>r{k}\nAC\n>>odd{k}\nGT\n" if k else ">r0\nAC\n>>odd0\nGT\n")
    got = sorted((r.name, r.seq) for r in reads.read_fasta(spark, str(tmp_path / "many")).collect())
    assert got == sorted([(f"r{k}", "AC") for k in range(5)] + [(f">odd{k}", "GT") for k in range(5)])
    (tmp_path / "b.fa.gzip").write_bytes(gzip.compress(b">x\nAC\nGT\n>y\n"))
    assert sorted((r.name, r.seq) for r in reads.read_fasta(spark, str(tmp_path / "b.fa.gzip")).collect()) == [("x", "ACGT"), ("y", "")]
    df = spark.createDataFrame([(0, "n", "ACGT"), (1, "m", "")], "seq_id long, name string, seq string")
    for path in ("c.fa.gz", "c.zlib.bcseq", "c.raw.bcseq"):
        dispatch.save_sequences(df, str(tmp_path / path))
        assert sorted((r.name, r.seq) for r in dispatch.open_sequences(spark, str(tmp_path / path)).collect()) == [("m", ""), ("n", "ACGT")]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1\nACGT\n\n+\n@!!~\n\n@r2\nN\n+x\n#")
    df = dispatch.open_reads(spark, str(tmp_path / "a.fastq"))
    assert sorted(map(tuple, df.collect())) == [(0, "r1", "ACGT", "@!!~"), (1, "r2", "N", "#")]
    dispatch.save_reads(df, str(tmp_path / "b.fq"))
    assert sorted(r.name for r in dispatch.open_reads(spark, str(tmp_path / "b.fq")).collect()) == ["r1", "r2"]
    for bad in ("r1\nA\n+\n!\n", "@r\nA\n-\n!\n", "@r\nAC\n+\n!\n", "@r\nA\n+\n"):
        (tmp_path / "bad.fastq").write_text(bad)
        with pytest.raises(Exception, match="malformed"):
            dispatch.open_reads(spark, str(tmp_path / "bad.fastq")).collect()


@pytest.mark.parametrize("suffix", [".raw.bsgrap", ".zlib.bsgrap"])
def test_graphs(spark, tmp_path, suffix):
    df = spark.createDataFrame([(0, "a", "ACGTN", "!5I~#"), (1, "b", "", "")], "read_id long, name string, seq string, qual string")
    g = sequences.reads_to_graphs(df, [0.1, 0.2, 0.8, 0.1, 0.2, 0.8])
    assert sequences.graph_faults(g).count() == 0
    first = g.filter("graph_id = 0").first()
    assert (first.num_links, len(first.contigs[0].pos), len(first.suffix)) == (1, 5, 5) and first.in_links[0] == (0, 1) and first.out_links[0] == (0, 0, 1.0)
    assert first.contigs[0].pos[4].base == [0.25] * 4
    path = str(tmp_path / ("g" + suffix))
    dispatch.save_graphs(g, path, "reads")
    back = dispatch.open_graphs(spark, path)
    key = lambda r: r.name
    assert [r.asDict(True) | {"graph_id": 0} for r in sorted(back.collect(), key=key)] == [r.asDict(True) | {"graph_id": 0} for r in sorted(g.collect(), key=key)]
    one = next(f for f in binary.files_of(path) if binary.size_of(f))
    assert blocks.graph_shape(one)[:3] == ("reads", 0, "ACGT")


def test_alignments(spark, tmp_path):
    schema = binary.ALIGNMENTS
    rows = [(i, 2 * i, -0.5 * i, 0, 1, 2, 3, [("M", 5), ("i", 1)][: i % 3]) for i in range(7)]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "a.zlib.bsalgn")
    binary.write(df, path, ".zlib.bsalgn")
    got = sorted(((*r[:7], [tuple(e) for e in r.events]) for r in binary.read(spark, path).collect()))
    assert got == rows


def test_matrices_and_loadings():
    rows = [[1.0, -2.5], [3.0, 4.0], [0.0, 1e-300]]
    assert blocks.unpack_matrix(blocks.pack_matrix(rows)) == rows
    with pytest.raises(ValueError):
        blocks.unpack_matrix(blocks.pack_matrix(rows)[:-1])
    data = blocks.pack_loadings(2, 3, [1, 1], 32, [[1, 2], [3, 0]])
    assert blocks.unpack_loadings(data) == (2, 3, [1, 1], 32, [[1, 2], [3, 0]])
    with pytest.raises(ValueError):
        blocks.unpack_loadings(data[::-1])


def test_text_matrix(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("1\t2.5\n-3\t1e2\n")
    assert sorted(map(tuple, tables.read_matrix(spark, str(tmp_path / "m.tsv")).collect())) == [(0, 0, 1.0), (0, 1, 2.5), (1, 0, -3.0), (1, 1, 100.0)]
    (tmp_path / "r.tsv").write_text("1\t2\n3\n")
    with pytest.raises(ValueError):
        tables.read_matrix(spark, str(tmp_path / "r.tsv"))


def test_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "in.tsv").write_text(HEADER + "hot\t3\t2.5\tx\ncold\t\t\t\n")
    run = lambda *a: cli.run(list(map(str, a)))
    run("t2d", "--in", tmp_path / "in.tsv", "--head", "--sigil", "--out", tmp_path / "d.zlib.bcdat")
    run("d2t", "--in", tmp_path / "d.zlib.bcdat", "--out", tmp_path / "out.tsv")
    cells = [r.cells for r in tables.read_tsv(spark, str(tmp_path / "out.tsv")).collect()]
    assert sorted(cells) == sorted([HEADER.strip("\n").split("\t"), ["hot", "3", "2.500000e+00", "x"], ["cold", "", "", ""]])
    run("tconv", "--in", tmp_path / "in.tsv", "--out", tmp_path / "t.raw.bctab")
    assert dispatch.open_table(spark, str(tmp_path / "t.raw.bctab")).count() == 3
    (tmp_path / "s.fa").write_text(">a\nACGTT\n")
    run("s2sg", "--in", tmp_path / "s.fa", "--out", tmp_path / "g.zlib.bsgrap", "--eq", "NACGT")
    run("sconv", "--in", tmp_path / "s.fa", "--out", tmp_path / "s.zlib.bcseq")
    assert dispatch.open_graphs(spark, str(tmp_path / "g.zlib.bsgrap")).first().seq == "ACGTT"
    for name, extra in (("sampload", ["--load", 2, "--alleles", 2, "--ploidy", "1/1", "--cycles", 1]), ("drawread", ["--eval", tmp_path / "sim", "--reads", 2]), ("prototsv", [])):
        source = {"sampload": "-", "drawread": tmp_path / "sim", "prototsv": tmp_path / "scored"}[name]
        run(name, "--in", source, "--out", {"sampload": tmp_path / "sim", "drawread": tmp_path / "scored", "prototsv": tmp_path / "report.tsv"}[name], *extra)
    report = [r.cells for r in tables.read_tsv(spark, str(tmp_path / "report.tsv")).collect()]
    assert report[0][:3] == ["RC0", "RC1", "RightLoading"] or any(r[0] == "RC0" for r in report)
    monkeypatch.setattr("sys.stdin", io.StringIO("a\tb\n\nc\n"))
    assert [r.cells for r in dispatch.open_table(spark, "-").collect()] == [["a", "b"], ["c"]]


def test_process_and_discard(spark):
    lines = spark.createDataFrame([("b",), ("a",)], "value string").coalesce(1)
    assert [r.value for r in dispatch.open_process(spark, "sort", lines).collect()] == ["a", "b"]
    dispatch.discard(lines)


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.tsv").write_text("hot\t1\t2.5\tx\n\n")
    (folder / "2.tsv").write_text("cold\t2\t\ty\n")
    q = stream_typed(spark, str(folder), KINDS, files_per_trigger=1).writeStream.format("memory").queryName("typed_rows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("typed_rows").collect())) == [("cold", 2, None, "y"), ("hot", 1, 2.5, "x")]


def test_rendering(spark):
    df = spark.createDataFrame([(1, 2.5, None)], "a long, b double, c string")
    assert typed.to_text(df).first().cells == ["1", "2.500000e+00", ""]
    assert os.path.exists(cli.__file__)


def blocks_of(spark, path):
    return [r.cells for r in binary.read(spark, path).orderBy("row_id").collect()]


def test_appends_overwrites_and_retries(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *names: spark.createDataFrame([([n],) for n in names], "cells array<string>").repartition(2)
    binary.write(frame("a", "b", "c"), path, ".zlib.bctab")
    binary.write(frame("d", "e"), path, ".raw.bctab")
    assert sorted(blocks_of(spark, path)[:3]) == [["a"], ["b"], ["c"]] and sorted(blocks_of(spark, path)[3:]) == [["d"], ["e"]]
    # an attempt that ends early leaves nothing, and a second one for the same partition is not read twice
    writer = binary.Writer({"path": path, "suffix": ".zlib.bctab"}, frame("x").schema, False)
    os.makedirs(os.path.join(writer.work, "9"))
    blocks.write_text_table(os.path.join(writer.work, "9", "part-9.zlib.bctab"), [[b"lost"]])
    assert len(blocks_of(spark, path)) == 5
    writer.abort([])
    assert not [f for f in os.listdir(path) if f.startswith("_work")]
    with pytest.raises(Exception, match="too bad"):
        bad = frame("f").select(F.array(F.when(F.rand() >= 0, F.raise_error(F.lit("too bad"))).cast("string")).alias("cells"))
        binary.write(bad, path, ".zlib.bctab")
    assert len(blocks_of(spark, path)) == 5 and not [f for f in os.listdir(path) if f.startswith("_work")]
    binary.write(frame("z"), path, ".zlib.bctab", mode="overwrite")
    assert blocks_of(spark, path) == [["z"]]


def test_row_filters_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    reader = binary.Reader.__new__(binary.Reader)
    reader.first, reader.stop = 0, 1 << 63
    list(reader.pushFilters([GreaterThanOrEqual(("row_id",), 5), LessThan(("row_id",), 9), EqualTo(("name",), "x")]))
    assert (reader.first, reader.stop) == (5, 9)


def test_header_rows_among_the_data(spark, tmp_path):
    path = str(tmp_path / "t.tsv")
    with open(path, "w") as f:
        f.write("i:a\ts8:b\n1\tx\ni:a\ts8:b\n2\ty\n")
    assert [tuple(r) for r in tables.read_typed(spark, path).collect()] == [(1, "x"), (None, "s8:b"), (2, "y")]


@pytest.mark.parametrize("size", [None, "40b", "1000b"])
def test_reads_over_splits(spark, tmp_path, size):
    want = [(i, f"r{i}", "ACGT" * (i % 7 + 1), "@I+!" * (i % 7 + 1)) for i in range(97)]
    path = str(tmp_path / "t.fastq")
    with open(path, "w") as f:
        for _, n, s, q in want:
            f.write(f"@{n}\n{s}\n\n+\n{q}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert sorted(map(tuple, reads.read_fastq(spark, path).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with open(path, "a") as f:
        f.write("@cut\nAC\n+\n")
    with pytest.raises(ValueError, match="truncated"):
        reads.read_fastq(spark, path)


def test_packed_fasta_is_read_as_a_stream(spark, tmp_path):
    for k in range(2):
        with gzip.open(tmp_path / f"{k}.fa.gzip", "wt") as f:
            f.write(f"text before\n>one {k}\nAC GT\nAA\n>two\n>three\nT\n")
    got = sorted((r.name, r.seq) for r in reads.read_fasta(spark, str(tmp_path / "*.fa.gzip")).collect())
    assert got == sorted([(f"one {k}", "ACGTAA") for k in range(2)] + [("three", "T"), ("two", "")] * 2)


def test_standard_input_and_output(spark):
    lines = [f"{i}\tx" for i in range(250)]
    got = tables.read_lines(spark, iter(f"{x}\n" for x in lines), batch=100)
    assert sorted(r.value for r in got.collect()) == sorted(lines) and tables.read_lines(spark, iter(())).count() == 0
    out = io.StringIO()
    tables.write_lines(got.orderBy("value"), out)
    assert out.getvalue().splitlines() == sorted(lines)


def test_header_and_rows_over_files_of_any_size(spark, tmp_path):
    """Spark packs the largest files first; the header and the order of rows are those of the files' names."""
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "part-0.tsv").write_text("\n\ni:a\ts8:b\n")
    want = []
    for k, n in ((1, 3), (2, 4000), (3, 500), (4, 0), (5, 9000)):
        own = [(len(want) + i, f"t{(len(want) + i) % 97}") for i in range(n)]
        (folder / f"part-{k}.tsv").write_text("".join(f"{a}\t{b}\n" for a, b in own))
        want += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert sorted(map(tuple, tables.read_typed(spark, str(folder)).collect())) == want
        for _ in range(2):
            got = sorted((r.row_id, tuple(r.cells)) for r in tables.read_numbered(spark, str(folder)).collect())
            assert got == list(enumerate([("i:a", "s8:b"), *((str(a), b) for a, b in want)]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_matrix_rows_over_files(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"m{k}.tsv").write_text("".join(f"{k}\t{i}\n" for i in range((3, 400, 1, 60)[k])))
    want = [(float(k), float(i)) for k in range(4) for i in range((3, 400, 1, 60)[k])]
    got = {(r.i, r.j): r.v for r in tables.read_matrix(spark, str(tmp_path / "m*.tsv")).collect()}
    assert got == {(n, j): x[j] for n, x in enumerate(want) for j in (0, 1)}


def test_ids_of_records_over_files(spark, tmp_path):
    """Records of several files, cut into many splits, get the same ids at every reading."""
    for k, n in enumerate((2, 300, 40)):
        (tmp_path / f"r{k}.fastq").write_text("".join(f"@r{k}-{i}\nACGT\n+\n@@@@\n" for i in range(n)))
        (tmp_path / f"s{k}.fa").write_text("text before\n" * (k == 1) + "".join(f">s{k}-{i}\nAC\nGT\n" for i in range(n)))
    names = [f"{k}-{i}" for k, n in enumerate((2, 300, 40)) for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for _ in range(2):
            assert sorted((r.read_id, r.name) for r in reads.read_fastq(spark, str(tmp_path / "*.fastq")).collect()) == [(i, f"r{n}") for i, n in enumerate(names)]
            assert sorted((r.seq_id, r.name, r.seq) for r in reads.read_fasta(spark, str(tmp_path / "*.fa")).collect()) == [(i, f"s{n}", "ACGT") for i, n in enumerate(names)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbers_of_sorted_rows_hold_over_readings(spark):
    df = spark.range(5000).selectExpr("hash(id) AS h", "id AS row").repartition(7).orderBy("h", "row")
    numbered = rows.numbered(df, "n")
    want = sorted((r.h, r.row) for r in df.collect())
    assert sorted((r.n, r.h, r.row) for r in numbered.collect()) == [(i, *x) for i, x in enumerate(want)] == sorted((r.n, r.h, r.row) for r in numbered.collect())


def test_programs_that_fail_say_why(spark):
    with pytest.raises(Exception, match="no such place|No such file"):
        dispatch.open_process(spark, "ls /no/such/place").collect()
    many = spark.range(50_000).selectExpr("cast(id AS string) AS value").repartition(3)
    assert sorted(int(r.value) for r in dispatch.open_process(spark, "cat", many).collect()) == list(range(50_000))
    assert len(dispatch.open_process(spark, "head -n 1", many).collect()) == 3


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """A matrix of 2.4 GB, mostly a hole in the file, is read by ranges; a task seeks to its own."""
    rows_, columns = 300_000, 1000
    path = str(tmp_path / "big")
    with open(path, "wb") as f:
        f.write(struct.pack(">2Q", rows_, columns))
        f.truncate(16 + 8 * rows_ * columns)
        f.seek(16 + 8 * (299_999 * columns + 7))
        f.write(struct.pack(">d", 2.5))
    reader = streams.FixedReader({"path": path, "kind": "matrix", "part": str(1 << 24)})
    parts = reader.partitions()
    assert len(parts) == 144 and parts[-1].stop == rows_ * columns
    last = [b.to_pydict() for b in reader.read(parts[-1])]
    assert sum(map(len, (b["v"] for b in last))) == parts[-1].stop - parts[-1].first
    assert [(i, j, v) for b in last for i, j, v in zip(b["i"], b["j"], b["v"], strict=True) if v] == [(299_999, 7, 2.5)]


def test_paths_of_unknown_stores_are_errors():
    with pytest.raises(Exception, match="nosuch|[Uu]nrecognized"):
        store.open_in("nosuch://store/in/x")


@pytest.mark.parametrize("suffix", [".bdat", ".bdat.gz", ".zlib.bcdat"])
def test_numbers_choose_rows_of_fixed_width(spark, tmp_path, suffix, monkeypatch):
    """Over several files; only the partitions that hold the wanted rows are made, and only these rows are read."""
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    folder = str(tmp_path / "d")
    frame = spark.createDataFrame([(k, f"t{k}") for k in range(300)], "k long, t string")
    for low, high in ((0, 40), (40, 250), (250, 300)):
        binary.write(frame.filter((F.col("k") >= low) & (F.col("k") < high)).coalesce(1), folder, suffix)
    df = binary.read(spark, folder, rows=20, number="n")
    assert df.columns == ["n", "k", "t"] and sorted((r.n, r.k, r.t) for r in df.collect()) == [(k, k, f"t{k}") for k in range(300)]
    assert sorted(r.k for r in df.filter("n >= 35 and n < 75").collect()) == list(range(35, 75))
    reader = binary.Reader({"path": folder, "rows": "20", "number": "n"})
    list(reader.pushFilters([GreaterThanOrEqual(("n",), 35), LessThan(("n",), 75)]))
    read = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("n").to_pylist()]
    assert sorted(read) == list(range(35, 75))
    with pytest.raises(Exception, match="has a column k"):
        binary.read(spark, folder, number="k")


def test_packed_batches_are_the_same_bytes(tmp_path):
    """Arrow writers against the row-wise ones, with nulls, empty cells, sliced batches and texts of other alphabets."""
    rng = np.random.default_rng(3)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(list("abé日 "), int(rng.integers(0, 9)))) for _ in range(400)]
    cells = [[texts[i] for i in rng.integers(0, 400, int(rng.integers(0, 5)))] for _ in range(300)]
    frame = lambda columns, names: pa.RecordBatch.from_arrays(columns, names=names)
    same = lambda a, b, parts: all((tmp_path / (a + p)).read_bytes() == (tmp_path / (b + p)).read_bytes() for p in parts)
    blk = lambda *parts: [x for p in parts for x in (p, p + ".blk")]

    def packed(out, batch):
        for at in range(0, batch.num_rows, 70):
            out.add(batch.slice(at, 70))
        out.close()

    packed(packing.TextTable(str(tmp_path / "a.zlib.bctab")), frame([pa.array(cells, pa.list_(pa.string()))], ["cells"]))
    blocks.write_text_table(str(tmp_path / "b.zlib.bctab"), [[(c or "").encode() for c in r] for r in cells])
    assert same("a.zlib.bctab", "b.zlib.bctab", blk("", ".ind"))
    packed(packing.Sequences(str(tmp_path / "a.zlib.bcseq")), frame([pa.array(texts), pa.array(texts[::-1])], ["name", "seq"]))
    blocks.write_sequences(str(tmp_path / "b.zlib.bcseq"), [(a or "", b or "") for a, b in zip(texts, texts[::-1], strict=True)])
    assert same("a.zlib.bcseq", "b.zlib.bcseq", blk("", ".ind", ".seq", ".seq.ind"))
    values = [[rng.choice(["cold", "hot", "odd", None]), None if k % 7 == 0 else int(rng.integers(-9, 9)), None if k % 5 == 0 else float(rng.normal()), None if k % 3 == 0 else texts[k] and texts[k][:2]] for k in range(300)]
    batch = frame([pa.array([v[k] for v in values], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.string()))], ["temp", "count", "score", "tag"])
    for suffix in (".bdat", ".zlib.bcdat"):
        packed(packing.Data(str(tmp_path / f"a{suffix}"), KINDS), batch)
        blocks.write_data(str(tmp_path / f"b{suffix}"), KINDS, values)
        assert same(f"a{suffix}", f"b{suffix}", [""])
    with pytest.raises(ValueError, match="longer"):
        packing.Data(str(tmp_path / "c.bdat"), KINDS).add(frame([pa.array(["hot"]), pa.array([1]), pa.array([1.0]), pa.array(["123456789"])], ["temp", "count", "score", "tag"]))
    names = [*packing.ALIGNMENT.names[:-1], "events"]
    told = [{c: (float(k) if c == "log_prob" else k) for c in names[:-1]} | {"events": [{"type": "MIiXxLl"[(k + i) % 7], "n": i} for i in range(k % 4)]} for k in range(200)]
    kind = pa.schema([(c, pa.float64() if c == "log_prob" else pa.int64()) for c in names[:-1]] + [("events", pa.list_(pa.struct([("type", pa.string()), ("n", pa.int32())])))])
    packed(packing.Alignments(str(tmp_path / "a.zlib.bsalgn")), pa.RecordBatch.from_pylist(told, schema=kind))
    blocks.write_alignments(str(tmp_path / "b.zlib.bsalgn"), told)
    assert same("a.zlib.bsalgn", "b.zlib.bsalgn", blk("", ".ent"))
    back = [dict(zip(names, row, strict=True)) for _, columns in packing.alignment_batches(str(tmp_path / "a.zlib.bsalgn"), 30, 90, 17) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
    assert back == told[30:90]


def test_packed_graphs_are_the_same_bytes(tmp_path):
    """Against the row-wise writer, in slices; and back, from any graph on."""
    rng = np.random.default_rng(6)
    number = lambda: float(np.float32(rng.random()))

    def contig():
        pos = [{c: number() for c in packing.GAPS} | {"base": [number() for _ in "ACGT"]} for _ in range(int(rng.integers(0, 4)))]
        return {"size": len(pos), "pos": pos, "tail": {c: number() for c in packing.GAPS[:3]}}

    def graph(k):
        links = int(rng.integers(0, 3))
        return {
            "name": f"gé{k}", "seq": "ACGT"[: k % 5], "extra": bytes(range(k % 7)), "contigs": [contig() for _ in range(k % 4)], "in_links": [{"contig": i, "link": k} for i in range(links)],
            "out_links": [{"link": k, "contig": i, "p": number()} for i in range(links)], "num_links": links, "suffix": list(range(k % 6)),
        }

    graphs = [graph(k) for k in range(60)]
    f4, i8 = pa.float32(), pa.int64()
    pos = pa.struct([*((c, f4) for c in packing.GAPS), ("base", pa.list_(f4))])
    kind = pa.schema([
        ("name", pa.string()), ("seq", pa.string()), ("extra", pa.binary()), ("contigs", pa.list_(pa.struct([("size", i8), ("pos", pa.list_(pos)), ("tail", pa.struct([(c, f4) for c in packing.GAPS[:3]]))]))),
        ("in_links", pa.list_(pa.struct([("contig", i8), ("link", i8)]))), ("out_links", pa.list_(pa.struct([("link", i8), ("contig", i8), ("p", f4)]))), ("num_links", i8), ("suffix", pa.list_(i8)),
    ])
    batch = pa.RecordBatch.from_pylist(graphs, schema=kind)
    a, b = str(tmp_path / "a.zlib.bsgrap"), str(tmp_path / "b.zlib.bsgrap")
    out = packing.Graphs(a, "some", "ACGT")
    for at in range(0, 60, 13):
        out.add(batch.slice(at, 13))
    out.close()
    assert blocks.write_graphs(b, "some", "ACGT", graphs) == out.rows == 60
    for p in blocks.GRAPH_PARTS:
        for s in ("", ".blk"):
            assert open(a + p + s, "rb").read() == open(b + p + s, "rb").read()
    for first, stop in ((0, 60), (17, 41), (59, 99), (60, 70)):
        back = [dict(zip(kind.names, row, strict=True)) for _, columns in packing.graph_batches(a, first, stop, 9) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
        assert back == graphs[first:stop]


def test_block_folders_as_streams(spark, tmp_path):
    """Sets that arrive between and during runs are read once each, over a restart, and a batch that comes again adds nothing."""
    from strandline.streaming import stream_blocks, write_blocks

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = lambda a, b: spark.createDataFrame([([str(k)],) for k in range(a, b)], "cells array<string>").repartition(2)
    binary.write(frame(0, 30), folder, ".zlib.bctab")
    binary.write(frame(30, 31), folder, ".zlib.bctab")
    start = lambda: write_blocks(stream_blocks(spark, folder, rows=7, sets=1).select("cells"), out, ".raw.bctab", str(tmp_path / "state"), "s")
    run = start()
    run.processAllAvailable()
    binary.write(frame(31, 50), folder, ".zlib.bctab")
    run.processAllAvailable()
    run.stop()
    binary.write(frame(50, 90), folder, ".zlib.bctab")
    run = start()
    run.processAllAvailable()
    run.stop()
    assert sorted(int(r.cells[0]) for r in binary.read(spark, out).collect()) == list(range(90))
    assert [n["batch"] for _, n in binary.notes_in(out)] == [0, 1, 2, 3]
    writer = binary.StreamWriter({"path": out, "suffix": ".raw.bctab", "stream": "s"}, frame(0, 1).schema)
    os.makedirs(os.path.join(writer.work, "5"))
    blocks.write_text_table(os.path.join(writer.work, "5", "part-x.raw.bctab"), [[b"again"]])
    writer.commit([binary.Done(os.path.join(writer.work, "5"), 1)], 3)
    assert binary.read(spark, out).count() == 90 and not [f for f in os.listdir(out) if f.startswith("_work")]
    numbers = spark.readStream.format("strandline").option("rows", "9").load(folder).select("row_id").writeStream.format("memory").queryName("numbers").trigger(availableNow=True).start()
    numbers.awaitTermination()
    assert sorted(r.row_id for r in spark.table("numbers").collect()) == list(range(90))


def test_ranges_of_sealed_files(spark, tmp_path):
    """Any range of bytes equals that of the whole; files of one folder share no block."""
    from strandline.functions import crypto
    from strandline.sources import sealed

    key, folder = F.lit(bytes(range(32))), str(tmp_path / "s")
    lines = spark.range(40_000).selectExpr("concat('row é ', id) AS value").repartition(2)
    sealed.write_sealed(lines, folder, key, 5)
    with pytest.raises(ValueError, match="used again"):
        sealed.write_sealed(lines, folder, key, 5)
    whole = {}
    for r in sealed.read_sealed(spark, folder, key, 5).orderBy("file", "at").collect():
        assert len(whole.setdefault(r.file, b"")) == r.at
        whole[r.file] += r.data
    told = b"".join(whole.values()).decode().split("\n")[:-1] if len(whole) == 2 else []
    assert sorted(told) == sorted(f"row é {k}" for k in range(40_000)) and min(map(len, whole.values())) > 2 * sealed.PIECE
    file, plain = max(whole.items(), key=lambda x: len(x[1]))
    on_disk = open(file.removeprefix("file://"), "rb").read()
    assert len(on_disk) == len(plain) and on_disk[:64] != plain[:64]
    rng = np.random.default_rng(1)
    for low, size in [(0, 1), (15, 3), (sealed.PIECE - 1, 2), (len(plain) - 5, 50), *((int(a), int(b)) for a, b in zip(rng.integers(0, len(plain), 3), rng.integers(1, 150_000, 3), strict=True))]:
        got = sealed.read_sealed(spark, file, key, 5, low, low + size).orderBy("at").collect()
        assert b"".join(r.data for r in got) == plain[low : low + size] and got[0].at == low
    part = int(file[-13:-7])
    first = spark.range(1).select(crypto.counter_mode(F.lit(plain[:32]), key, 5, F.lit(part << 40).cast("bigint"))).first()[0]
    assert first == on_disk[:32]
