"""Arrow batches as bytes of the block formats, and back: offsets and cells are moved by NumPy, no row by Python.

A writer takes batches one after the other and keeps its files open; its files are those that the row-wise writers of ``blocks``
make.  Nulls in texts and lists count as empty.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..schema import ColumnKind
from . import blocks, store

ALIGNMENT = np.dtype([("read_index", ">i8"), ("ref_index", ">i8"), ("log_prob", ">f8"), ("start_contig_ref", ">i8"), ("start_index_ref", ">i8"), ("start_contig_read", ">i8"), ("start_index_read", ">i8"), ("begin", ">i8")])
EVENT = np.dtype([("type", "u1"), ("n", ">u4")])


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and their offsets."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def list_parts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Items of all lists one after the other, and the offsets of the lists; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.append(0, np.cumsum(sizes))


def put_texts(out: np.ndarray, places: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
    """Copies text k to place k."""
    sizes = np.diff(offsets)
    index = np.repeat(places - offsets[:-1], sizes)
    index += np.arange(len(raw))
    out[index] = raw


def put_numbers(out: np.ndarray, places: np.ndarray, values: np.ndarray, kind: str) -> None:
    """Writes number k at place k, in bytes of a NumPy kind."""
    width = np.dtype(kind).itemsize
    out[places[:, None] + np.arange(width)] = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, width)


class TextTable:
    """Rows of text cells and the index of their begins."""

    def __init__(self, path: str):
        codec = blocks.codec_of(path)
        self.data, self.index, self.rows = blocks.BlockWriter(path, codec), blocks.BlockWriter(path + ".ind", codec), 0

    def add(self, batch: pa.RecordBatch) -> None:
        cells, rows = list_parts(batch.column("cells"))
        raw, at = text_parts(cells)
        sizes = np.diff(at)
        # a row is its number of cells, then a length and the bytes of each
        ends = np.append(0, np.cumsum(sizes + 8))
        begin = ends[rows[:-1]] + 8 * np.arange(len(rows) - 1)
        row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        place = ends[:-1] + 8 * (row_of + 1)
        out = np.zeros(int(ends[-1]) + 8 * (len(rows) - 1), dtype=np.uint8)
        put_numbers(out, begin, np.diff(rows), ">u8")
        put_numbers(out, place, sizes, ">u8")
        put_texts(out, place + 8, raw, at)
        self.index.write((begin + self.data.tell()).astype(">u8").tobytes())
        self.data.write(out.tobytes())
        self.rows += len(rows) - 1

    def close(self) -> None:
        self.data.close()
        self.index.close()


class Sequences:
    """Names and sequences, each with the index of their begins."""

    def __init__(self, path: str):
        codec = blocks.codec_of(path)
        self.parts, self.rows = [(c, blocks.BlockWriter(path + s, codec), blocks.BlockWriter(path + s + ".ind", codec)) for c, s in (("name", ""), ("seq", ".seq"))], 0

    def add(self, batch: pa.RecordBatch) -> None:
        for column, data, index in self.parts:
            raw, at = text_parts(batch.column(column))
            index.write((at[:-1] + data.tell()).astype(">u8").tobytes())
            data.write(raw.tobytes())
        self.rows += batch.num_rows

    def close(self) -> None:
        for _, data, index in self.parts:
            data.close()
            index.close()


def row_kind(kinds: list[ColumnKind]) -> np.dtype:
    """A row of fixed width: for each column whether it is missing, then its value."""
    return np.dtype([(f"{what}{k}", t) for k, c in enumerate(kinds) for what, t in (("na", "u1"), ("v", f"V{c.length}" if c.kind == "str" else ">f8" if c.kind == "real" else ">i8"))])


class Data:
    """Rows of fixed width after a header of the columns."""

    def __init__(self, path: str, kinds: list[ColumnKind]):
        self.kinds, self.kind, self.rows = kinds, row_kind(kinds), 0
        self.file = None
        if path.endswith(".bcdat"):
            self.out = blocks.BlockWriter(path, blocks.codec_of(path))
        elif path.endswith((".gz", ".gzip")):
            self.file = store.open_out(path)
            self.out = gzip.open(self.file, "wb")
        else:
            self.out = store.open_out(path)
        self.out.write(blocks.pack_header(kinds))

    def add(self, batch: pa.RecordBatch) -> None:
        out = np.zeros(batch.num_rows, dtype=self.kind)
        for k, c in enumerate(self.kinds):
            column = batch.column(k)
            if c.kind == "cat":
                levels = list(c.levels)
                column = pa.array([c.levels[x] for x in levels], pa.int64()).take(pc.index_in(column.cast(pa.string()), pa.array(levels, pa.string())))
            missing = column.is_null().to_numpy(zero_copy_only=False)
            out[f"na{k}"] = missing
            if c.kind == "str":
                raw, at = text_parts(column)
                sizes = np.diff(at)
                if len(sizes) and sizes.max() > c.length:
                    raise ValueError(f"{c.name} is longer than {c.length} bytes")
                padded = np.zeros(len(sizes) * c.length, dtype=np.uint8)
                put_texts(padded, np.arange(len(sizes)) * c.length, raw, at)
                out[f"v{k}"] = padded.view(f"V{c.length}") if c.length else out[f"v{k}"]
            elif c.kind == "real":
                out[f"v{k}"] = pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            else:
                out[f"v{k}"] = pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        self.out.write(out.tobytes())
        self.rows += batch.num_rows

    def close(self) -> None:
        self.out.close()
        if self.file is not None:
            self.file.close()


class Alignments:
    """Alignments of fixed width and the events they point to."""

    def __init__(self, path: str):
        codec = blocks.codec_of(path)
        self.index, self.entries, self.rows = blocks.BlockWriter(path, codec), blocks.BlockWriter(path + ".ent", codec), 0

    def add(self, batch: pa.RecordBatch) -> None:
        events, at = list_parts(batch.column("events"))
        out = np.zeros(batch.num_rows, dtype=ALIGNMENT)
        for c in ALIGNMENT.names[:-1]:
            out[c] = batch.column(c).to_numpy(zero_copy_only=False)
        out["begin"] = at[:-1] + self.entries.tell() // EVENT.itemsize
        told = np.zeros(len(events), dtype=EVENT)
        known = pc.index_in(events.field("type"), pa.array(list(blocks.EVENTS)))
        if known.null_count:
            raise ValueError(f"unknown event {events.field('type')[int(np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))[0])].as_py()!r}")
        told["type"] = np.frombuffer(blocks.EVENTS.encode(), np.uint8)[known.to_numpy()]
        told["n"] = events.field("n").to_numpy(zero_copy_only=False)
        self.index.write(out.tobytes())
        self.entries.write(told.tobytes())
        self.rows += batch.num_rows

    def close(self) -> None:
        self.index.close()
        self.entries.close()


def alignment_batches(path: str, first: int, stop: int, size: int = 8192) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Numbers and columns of alignments, in batches; the events of a batch are read at once."""
    codec = blocks.codec_of(path)
    index, entries = blocks.BlockReader(path, codec), blocks.BlockReader(path + ".ent", codec)
    n = blocks.alignments_size(path)
    if entries.size() % EVENT.itemsize:
        raise ValueError("events are truncated")
    stop = min(stop, n)
    for i in range(first, stop, size):
        j = min(stop, i + size)
        here = np.frombuffer(index.read(64 * i, 64 * (min(j + 1, n) - i)), ALIGNMENT)
        begin = here["begin"].astype(np.int64)
        begin = begin if j < n else np.append(begin, entries.size() // EVENT.itemsize)
        if (np.diff(begin) < 0).any():
            raise ValueError("offsets do not ascend")
        told = np.frombuffer(entries.read(EVENT.itemsize * int(begin[0]), EVENT.itemsize * int(begin[-1] - begin[0])), EVENT)
        names = np.full(256, -1)
        names[np.frombuffer(blocks.EVENTS.encode(), np.uint8)] = np.arange(len(blocks.EVENTS))
        which = names[told["type"]]
        if (which < 0).any():
            raise ValueError("unknown event")
        events = pa.StructArray.from_arrays([pa.array(list(blocks.EVENTS)).take(pa.array(which)), pa.array(told["n"].astype(np.int32))], names=["type", "n"])
        columns = [pa.array(np.ascontiguousarray(here[c][: j - i]).astype(float if c == "log_prob" else np.int64)) for c in ALIGNMENT.names[:-1]]
        yield np.arange(i, j), [*columns, pa.ListArray.from_arrays(pa.array((begin - begin[0]).astype(np.int32)), events)]


class Bytes:
    """The data of a frame's rows, one after the other."""

    def __init__(self, path: str):
        self.out, self.rows = store.open_out(path), 0

    def add(self, batch: pa.RecordBatch) -> None:
        for data in batch.column("data").to_pylist():
            self.out.write(data)
        self.rows += batch.num_rows

    def close(self) -> None:
        self.out.close()


GAPS = ("ins_open", "ins_ext", "ins_close", "del_open", "del_ext", "del_close")


class Graphs:
    """Sequence graphs: an index and nine streams, of which each graph has a stretch."""

    def __init__(self, path: str, name: str, bases: str):
        codec = blocks.codec_of(path)
        self.width, self.rows = 6 + len(bases), 0
        self.index, *self.parts = (blocks.BlockWriter(path + s, codec) for s in blocks.GRAPH_PARTS)
        self.index.write(blocks.pack_graph_header(name, 0, bases))

    def add(self, batch: pa.RecordBatch) -> None:
        contigs, by_graph = list_parts(batch.column("contigs"))
        pos, by_contig = list_parts(contigs.field("pos"))
        base, by_pos = list_parts(pos.field("base"))
        size = contigs.field("size").to_numpy(zero_copy_only=False).astype(np.int64)
        if (size != np.diff(by_contig)).any() or (np.diff(by_pos) != self.width - 6).any():
            raise ValueError("another number of probabilities than contigs need")
        # of each contig: width numbers a position, then three
        begin = np.append(0, np.cumsum(self.width * size + 3))
        probs = np.zeros(int(begin[-1]), dtype=">f4")
        place = np.repeat(begin[:-1], size) + self.width * (np.arange(len(pos)) - np.repeat(by_contig[:-1], size))
        for f, c in enumerate(GAPS):
            probs[place + f] = pos.field(c).to_numpy(zero_copy_only=False)
        probs[(place[:, None] + np.arange(6, self.width)).ravel()] = base.to_numpy(zero_copy_only=False)
        for f, c in enumerate(GAPS[:3]):
            probs[begin[1:] - 3 + f] = contigs.field("tail").field(c).to_numpy(zero_copy_only=False)
        ins, by_in = list_parts(batch.column("in_links"))
        outs, by_out = list_parts(batch.column("out_links"))
        suffix, by_suffix = list_parts(batch.column("suffix"))
        pairs = lambda x, *names: np.stack([x.field(c).to_numpy(zero_copy_only=False) for c in names], axis=1).astype(">u8").tobytes()
        names, by_name = text_parts(batch.column("name"))
        seqs, by_seq = text_parts(batch.column("seq"))
        extra = batch.column("extra").to_pylist()
        by_extra = np.append(0, np.cumsum([len(x or b"") for x in extra])).astype(np.int64)
        streams = [
            (names.tobytes(), by_name), (size.astype(">u8").tobytes(), 8 * by_graph), (pairs(ins, "contig", "link"), 16 * by_in), (pairs(outs, "link", "contig"), 16 * by_out), (probs.tobytes(), 4 * begin[by_graph]),
            (outs.field("p").to_numpy(zero_copy_only=False).astype(">f4").tobytes(), 4 * by_out), (seqs.tobytes(), by_seq), (suffix.to_numpy(zero_copy_only=False).astype(">u8").tobytes(), 8 * by_suffix), (b"".join(x or b"" for x in extra), by_extra),
        ]
        entries = [at[:-1] + part.tell() for part, (_, at) in zip(self.parts, streams, strict=True)]
        entries.append(batch.column("num_links").to_numpy(zero_copy_only=False))
        self.index.write(np.stack(entries, axis=1).astype(">u8").tobytes())
        for part, (data, _) in zip(self.parts, streams, strict=True):
            part.write(data)
        self.rows += batch.num_rows

    def close(self) -> None:
        for f in (self.index, *self.parts):
            f.close()


def graph_batches(path: str, first: int, stop: int, size: int = 256) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Numbers and columns (name, seq, extra, contigs, in_links, out_links, num_links, suffix) of graphs; each stream of a batch is read at once."""
    codec = blocks.codec_of(path)
    _, _, bases, head, n = blocks.graph_shape(path)
    index, *parts = (blocks.BlockReader(path + s, codec) for s in blocks.GRAPH_PARTS)
    ends = np.array([p.size() for p in parts], dtype=np.int64)
    width, stop = 6 + len(bases), min(stop, n)
    lists = lambda bounds, items: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), items)
    numbers = lambda x: pa.array(x.astype(np.int64))
    floats = lambda x: pa.array(x.astype(np.float32))
    for i in range(first, stop, size):
        j = min(stop, i + size)
        here = np.frombuffer(index.read(head + 80 * i, 80 * (min(j + 1, n) - i)), ">u8").reshape(-1, 10).astype(np.int64)
        begins = here[:, :9] if j < n else np.vstack([here[:, :9], ends])
        if (np.diff(begins, axis=0) < 0).any():
            raise ValueError("offsets do not ascend")
        raw = [p.read(int(b[0]), int(b[-1] - b[0])) for p, b in zip(parts, begins.T, strict=True)]
        at = [b - b[0] for b in begins.T]
        sizes, ins, outs, suffix = (np.frombuffer(raw[k], ">u8").astype(np.int64) for k in (1, 2, 3, 7))
        probs, link_p = np.frombuffer(raw[4], ">f4"), np.frombuffer(raw[5], ">f4")
        by_graph = at[1] // 8
        begin = np.append(0, np.cumsum(width * sizes + 3))
        if (4 * begin[by_graph] != at[4]).any() or len(link_p) != len(outs) // 2:
            raise ValueError("another number of probabilities than contigs need")
        by_contig = np.append(0, np.cumsum(sizes))
        place = np.repeat(begin[:-1], sizes) + width * (np.arange(by_contig[-1]) - np.repeat(by_contig[:-1], sizes))
        base = lists(np.arange(len(place) + 1) * (width - 6), floats(probs[(place[:, None] + np.arange(6, width)).ravel()]))
        pos = pa.StructArray.from_arrays([*(floats(probs[place + f]) for f in range(6)), base], names=[*GAPS, "base"])
        tail = pa.StructArray.from_arrays([floats(probs[begin[1:] - 3 + f]) for f in range(3)], names=list(GAPS[:3]))
        contigs = pa.StructArray.from_arrays([numbers(sizes), lists(by_contig, pos), tail], names=["size", "pos", "tail"])
        in_links = pa.StructArray.from_arrays([numbers(ins[::2]), numbers(ins[1::2])], names=["contig", "link"])
        out_links = pa.StructArray.from_arrays([numbers(outs[::2]), numbers(outs[1::2]), floats(link_p)], names=["link", "contig", "p"])
        extra = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.ascontiguousarray(at[8])), pa.py_buffer(raw[8])]).cast(pa.binary())
        yield (
            np.arange(i, j),
            [blocks.strings(raw[0], at[0]), blocks.strings(raw[6], at[6]), extra, lists(by_graph, contigs), lists(at[2] // 16, in_links), lists(at[3] // 16, out_links), numbers(here[: j - i, 9]), lists(at[7] // 8, numbers(suffix))],
        )
