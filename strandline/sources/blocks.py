"""Block-compressed files and the record formats that lie in them.

A block-compressed file has a side file ``.blk`` with, for each block, four unsigned 64-bit big-endian
numbers: begin before and after compression, length before and after compression.  Any range of the
original bytes is found by a binary search in it.  All integers in these formats are big-endian.
"""

from __future__ import annotations

import bisect
import gzip
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from ..schema import ColumnKind
from . import store

BLOCK, ENTRY = 65_536, 32
#: Entries of a side file that are read at once.
PAGE = 1024
#: Of the compression of blocks: fast, as tables are written once and mostly read.
LEVEL = 1
CODES = {"cat": 1, "int": 2, "real": 3, "str": 4}
KINDS = {v: k for k, v in CODES.items()}
GRAPH_PARTS = ("", ".name", ".csize", ".ilink", ".olink", ".cpro", ".lpro", ".rseq", ".sa", ".ext")
EVENTS = "MIiXxLl"


class BlockWriter:
    def __init__(self, path: str, codec: str, size: int = BLOCK):
        self.codec, self.size, self.held = codec, size, bytearray()
        self.data, self.notes = store.open_out(path), store.open_out(path + ".blk")
        self.before = self.after = 0

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= self.size:
            self._block(bytes(self.held[: self.size]))
            del self.held[: self.size]

    def _block(self, data: bytes) -> None:
        packed = zlib.compress(data, LEVEL) if self.codec == "zlib" else data
        self.data.write(packed)
        self.notes.write(struct.pack(">4Q", self.before, self.after, len(data), len(packed)))
        self.before += len(data)
        self.after += len(packed)

    def tell(self) -> int:
        return self.before + len(self.held)

    def close(self) -> None:
        if self.held:
            self._block(bytes(self.held))
            self.held.clear()
        self.data.close()
        self.notes.close()


class BlockReader:
    """Random access to the original bytes; one block is kept."""

    def __init__(self, path: str, codec: str):
        self.codec = codec
        self.data, self.notes = store.open_in(path), store.open_in(path + ".blk")
        if self.notes.size() % ENTRY:
            raise ValueError(f"{path}.blk is truncated")
        self.blocks = self.notes.size() // ENTRY
        self.page: tuple[int, np.ndarray] | None = None
        self.kept: tuple[int, bytes] | None = None

    def _entry(self, i: int) -> tuple[int, int, int, int]:
        if self.page is None or self.page[0] != i // PAGE:
            at = i // PAGE * PAGE
            self.notes.seek(at * ENTRY)
            self.page = (i // PAGE, np.frombuffer(self.notes.read(min(PAGE, self.blocks - at) * ENTRY), ">u8").reshape(-1, 4))
        return tuple(self.page[1][i % PAGE].tolist())

    def size(self) -> int:
        if not self.blocks:
            return 0
        last = self._entry(self.blocks - 1)
        return last[0] + last[2]

    def _load(self, i: int) -> tuple[int, bytes]:
        if self.kept is None or self.kept[0] != i:
            begin, at, length, packed = self._entry(i)
            self.data.seek(at)
            data = self.data.read(packed)
            data = zlib.decompress(data) if self.codec == "zlib" else data
            if len(data) != length:
                raise ValueError("a block has another length than its annotation")
            self.kept = (i, data)
        return self._entry(i)[0], self.kept[1]

    def read(self, at: int, length: int) -> bytes:
        if at + length > self.size():
            raise ValueError("read beyond the end")
        out = bytearray()
        i = bisect.bisect_right(range(self.blocks), at, key=lambda k: self._entry(k)[0]) - 1
        while length:
            begin, data = self._load(i)
            piece = data[at - begin : at - begin + length]
            out += piece
            at += len(piece)
            length -= len(piece)
            i += 1
        return bytes(out)

    def close(self) -> None:
        self.data.close()
        self.notes.close()


class PlainReader:
    """The same over an uncompressed file."""

    def __init__(self, path: str):
        self.data = store.open_in(path)

    def size(self) -> int:
        return self.data.size()

    def read(self, at: int, length: int) -> bytes:
        self.data.seek(at)
        out = self.data.read(length)
        if len(out) != length:
            raise ValueError("read beyond the end")
        return out

    def close(self) -> None:
        self.data.close()


class BytesReader:
    """The same over bytes in memory, for whole-file gzip."""

    def __init__(self, path: str):
        with store.open_in(path) as raw, gzip.open(raw, "rb") as f:
            self.data = f.read()

    def size(self) -> int:
        return len(self.data)

    def read(self, at: int, length: int) -> bytes:
        if at + length > len(self.data):
            raise ValueError("read beyond the end")
        return self.data[at : at + length]

    def close(self) -> None:
        pass


def codec_of(path: str) -> str:
    """raw or zlib, by the suffix before the last."""
    kind = path.rsplit(".", 2)[-2] if path.count(".") >= 2 else ""
    if kind not in ("raw", "zlib"):
        raise ValueError(f"unknown compression of {path}")
    return kind


class Offsets:
    """An index of 8-byte offsets, and the size of what it points into."""

    def __init__(self, index: BlockReader, data: BlockReader):
        self.index, self.data, self.end = index, data, data.size()
        if index.size() % 8:
            raise ValueError("index is truncated")
        self.n = index.size() // 8

    def span(self, i: int) -> tuple[int, int]:
        begin = struct.unpack(">Q", self.index.read(8 * i, 8))[0]
        stop = struct.unpack(">Q", self.index.read(8 * i + 8, 8))[0] if i + 1 < self.n else self.end
        if stop < begin:
            raise ValueError("offsets do not ascend")
        return begin, stop - begin


    def many(self, first: int, stop: int) -> np.ndarray:
        """Begins of the entries first .. stop - 1, and the end of the last; one read of the index."""
        here = min(stop + 1, self.n)
        out = np.frombuffer(self.index.read(8 * first, 8 * (here - first)), ">u8").astype(np.int64) if here > first else np.zeros(0, np.int64)
        out = np.append(out, self.end) if stop == self.n else out
        if (np.diff(out) < 0).any():
            raise ValueError("offsets do not ascend")
        return out


def strings(data: bytes, bounds: np.ndarray) -> pa.Array:
    """data[bounds[i]:bounds[i + 1]] as strings; bytes that are no UTF-8 are replaced."""
    found = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), pa.py_buffer(data)])
    try:
        return found.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())


def text_batches(path: str, first: int, stop: int, size: int = 4096) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Numbers and cells of rows, in batches; index and rows of a batch are read at once."""
    codec = codec_of(path)
    data, index = BlockReader(path, codec), BlockReader(path + ".ind", codec)
    offsets = Offsets(index, data)
    stop = min(stop, offsets.n)
    for i in range(first, stop, size):
        j = min(stop, i + size)
        begin = offsets.many(i, j)
        raw = data.read(int(begin[0]), int(begin[-1] - begin[0]))
        starts: list[int] = []
        ends: list[int] = []
        counts = []
        for at, end in zip((begin[:-1] - begin[0]).tolist(), (begin[1:] - begin[0]).tolist(), strict=True):
            (n,) = struct.unpack_from(">Q", raw, at)
            at += 8
            for _ in range(n):
                (length,) = struct.unpack_from(">Q", raw, at)
                at += 8
                if at + length > end:
                    raise ValueError("truncated row")
                starts.append(at)
                ends.append(at + length)
                at += length
            counts.append(n)
        cells = strings(b"".join([raw[a:b] for a, b in zip(starts, ends, strict=True)]), np.append(0, np.cumsum(np.array(ends, dtype=np.int64) - np.array(starts, dtype=np.int64))))
        yield np.arange(i, j), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), cells)


# ---- text tables


def pack_cells(cells: list[bytes]) -> bytes:
    return struct.pack(">Q", len(cells)) + b"".join(struct.pack(">Q", len(c)) + c for c in cells)


def unpack_cells(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from(">Q", data)
    at, out = 8, []
    for _ in range(n):
        (size,) = struct.unpack_from(">Q", data, at)
        if at + 8 + size > len(data):
            raise ValueError("truncated row")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def write_text_table(path: str, rows: Iterable[list[bytes]]) -> int:
    codec, n = codec_of(path), 0
    data, index = BlockWriter(path, codec), BlockWriter(path + ".ind", codec)
    for cells in rows:
        index.write(struct.pack(">Q", data.tell()))
        data.write(pack_cells(cells))
        n += 1
    data.close()
    index.close()
    return n


def text_table_size(path: str) -> int:
    index = BlockReader(path + ".ind", codec_of(path))
    try:
        return index.size() // 8
    finally:
        index.close()


def read_text_table(path: str, first: int, stop: int) -> Iterator[tuple[int, list[bytes]]]:
    codec = codec_of(path)
    data, index = BlockReader(path, codec), BlockReader(path + ".ind", codec)
    offsets = Offsets(index, data)
    for i in range(first, min(stop, offsets.n)):
        yield i, unpack_cells(data.read(*offsets.span(i)))


# ---- typed tables


def pack_header(kinds: list[ColumnKind]) -> bytes:
    out = [struct.pack(">Q", len(kinds)), bytes(CODES[k.kind] for k in kinds)]
    named = lambda s: struct.pack(">Q", len(s.encode())) + s.encode()
    out += [named(k.name) for k in kinds]
    for k in kinds:
        if k.kind == "cat":
            out.append(struct.pack(">Q", len(k.levels)))
            out += [named(v) + struct.pack(">Q", k.levels[v]) for v in sorted(k.levels)]
    out += [struct.pack(">Q", k.length) for k in kinds if k.kind == "str"]
    return b"".join(out)


def unpack_header(reader) -> tuple[list[ColumnKind], int]:
    """Kinds of the columns, and where the rows begin."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        return reader.read(at - n, n)

    number = lambda: struct.unpack(">Q", take(8))[0]
    n = number()
    codes = list(take(n))
    if any(c not in KINDS for c in codes):
        raise ValueError("unknown column type")
    names = [take(number()).decode("utf-8", "replace") for _ in range(n)]
    levels: list[dict[str, int]] = [{} for _ in range(n)]
    for i, c in enumerate(codes):
        if KINDS[c] == "cat":
            for _ in range(number()):
                level = take(number()).decode("utf-8", "replace")
                levels[i][level] = number()
    lengths = [number() if KINDS[c] == "str" else 0 for c in codes]
    return [ColumnKind(a, KINDS[c], v, s) for a, c, v, s in zip(names, codes, levels, lengths, strict=True)], at


def row_bytes(kinds: list[ColumnKind]) -> int:
    return sum(1 + (k.length if k.kind == "str" else 8) for k in kinds)


def pack_row(kinds: list[ColumnKind], values: list) -> bytes:
    out = []
    for k, v in zip(kinds, values, strict=True):
        if k.kind == "cat":
            v = k.levels.get(v)
        out.append(b"\x01" if v is None else b"\x00")
        if k.kind == "str":
            data = (v or "").encode()
            if len(data) > k.length:
                raise ValueError(f"{k.name} is longer than {k.length} bytes")
            out.append(data.ljust(k.length, b"\0"))
        elif k.kind == "real":
            out.append(struct.pack(">d", 0.0 if v is None else v))
        else:
            out.append(struct.pack(">q", 0 if v is None else v))
    return b"".join(out)


def data_reader(path: str):
    if path.endswith(".bcdat"):
        return BlockReader(path, codec_of(path))
    return BytesReader(path) if path.endswith((".gz", ".gzip")) else PlainReader(path)


def data_shape(path: str) -> tuple[list[ColumnKind], int, int]:
    """Kinds, where rows begin, and their number."""
    reader = data_reader(path)
    try:
        kinds, at = unpack_header(reader)
        width = row_bytes(kinds)
        left = reader.size() - at
        if width == 0 or left % width:
            raise ValueError("ragged file")
        return kinds, at, left // width
    finally:
        reader.close()


def data_batches(path: str, first: int, stop: int, size: int = 16_384) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Numbers and columns of rows of fixed width, in batches, by one structured NumPy type."""
    kinds, at, n = data_shape(path)
    reader, width = data_reader(path), row_bytes(kinds)
    from .packing import row_kind

    row = row_kind(kinds)
    stop = min(stop, n)
    for i in range(first, stop, size):
        j = min(stop, i + size)
        cells = np.frombuffer(reader.read(at + i * width, (j - i) * width), row)
        out = []
        for k, c in enumerate(kinds):
            missing, v = cells[f"na{k}"] != 0, cells[f"v{k}"]
            if c.kind == "real":
                out.append(pa.array(v.astype(float), mask=missing))
            elif c.kind == "int":
                out.append(pa.array(v.astype(np.int64), mask=missing))
            elif c.kind == "cat":
                names = {code: level for level, code in c.levels.items()}
                codes, back = np.unique(v.astype(np.int64), return_inverse=True)
                levels = pa.array([names.get(x) for x in codes.tolist()], pa.string())
                out.append(levels.take(pa.array(back, mask=missing)))
            else:
                raw = np.ascontiguousarray(v).tobytes()
                out.append(pa.array([None if na else raw[x * c.length : (x + 1) * c.length].rstrip(b"\0").decode("utf-8", "replace") for x, na in enumerate(missing.tolist())], pa.string()))
        yield np.arange(i, j), out


def write_data(path: str, kinds: list[ColumnKind], rows: Iterable[list]) -> int:
    n = 0
    if path.endswith(".bcdat"):
        out = BlockWriter(path, codec_of(path))
    else:
        out = gzip.open(path, "wb") if path.endswith((".gz", ".gzip")) else open(path, "wb")
    out.write(pack_header(kinds))
    for r in rows:
        out.write(pack_row(kinds, r))
        n += 1
    out.close()
    return n


# ---- sequences


def write_sequences(path: str, rows: Iterable[tuple[str, str]]) -> int:
    codec, n = codec_of(path), 0
    files = [BlockWriter(path + s, codec) for s in ("", ".ind", ".seq", ".seq.ind")]
    for name, seq in rows:
        files[1].write(struct.pack(">Q", files[0].tell()))
        files[0].write(name.encode())
        files[3].write(struct.pack(">Q", files[2].tell()))
        files[2].write(seq.encode())
        n += 1
    for f in files:
        f.close()
    return n


def _sequence_parts(path: str) -> tuple[Offsets, Offsets]:
    codec = codec_of(path)
    name, name_at, seq, seq_at = (BlockReader(path + s, codec) for s in ("", ".ind", ".seq", ".seq.ind"))
    names, seqs = Offsets(name_at, name), Offsets(seq_at, seq)
    if names.n != seqs.n:
        raise ValueError("as many names as sequences are needed")
    return names, seqs


def sequence_batches(path: str, first: int, stop: int, size: int = 4096) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    """Numbers, names and sequences, in batches; a batch's names and sequences are read at once."""
    names, seqs = _sequence_parts(path)
    stop = min(stop, names.n)
    for i in range(first, stop, size):
        j = min(stop, i + size)
        both = []
        for part in (names, seqs):
            begin = part.many(i, j)
            both.append(strings(part.data.read(int(begin[0]), int(begin[-1] - begin[0])), begin - begin[0]))
        yield np.arange(i, j), *both


# ---- sequence graphs


def pack_graph_header(name: str, version: int, bases: str) -> bytes:
    return struct.pack(">Q", len(name.encode())) + name.encode() + struct.pack(">QQ", version, len(bases)) + bases.encode()


def write_graphs(path: str, name: str, bases: str, graphs: Iterable[dict]) -> int:
    """Each graph as a dict with the fields of the graph schema; probabilities take 6 + bases floats a position and 3 a contig."""
    codec, n = codec_of(path), 0
    files = [BlockWriter(path + s, codec) for s in GRAPH_PARTS]
    files[0].write(pack_graph_header(name, 0, bases))
    for g in graphs:
        files[0].write(struct.pack(">10Q", *(f.tell() for f in files[1:]), g["num_links"]))
        files[1].write(g["name"].encode())
        for c in g["contigs"]:
            files[2].write(struct.pack(">Q", c["size"]))
            for p in c["pos"]:
                files[5].write(struct.pack(f">{6 + len(bases)}f", *(p[k] for k in ("ins_open", "ins_ext", "ins_close", "del_open", "del_ext", "del_close")), *p["base"]))
            files[5].write(struct.pack(">3f", *(c["tail"][k] for k in ("ins_open", "ins_ext", "ins_close"))))
        files[3].write(b"".join(struct.pack(">2Q", x["contig"], x["link"]) for x in g["in_links"]))
        files[4].write(b"".join(struct.pack(">2Q", x["link"], x["contig"]) for x in g["out_links"]))
        files[6].write(b"".join(struct.pack(">f", x["p"]) for x in g["out_links"]))
        files[7].write(g["seq"].encode())
        files[8].write(struct.pack(f">{len(g['suffix'])}Q", *g["suffix"]))
        files[9].write(bytes(g["extra"]))
        n += 1
    for f in files:
        f.close()
    return n


def graph_shape(path: str) -> tuple[str, int, str, int, int]:
    """Name, version, bases, where the index entries begin, and their number."""
    index = BlockReader(path, codec_of(path))
    try:
        number = lambda at: struct.unpack(">Q", index.read(at, 8))[0]
        size = number(0)
        name, version, bases = index.read(8, size).decode(), number(8 + size), number(16 + size)
        at = 24 + size + bases
        if (index.size() - at) % 80:
            raise ValueError("index is truncated")
        return name, version, index.read(24 + size, bases).decode(), at, (index.size() - at) // 80
    finally:
        index.close()


# ---- alignments


def write_alignments(path: str, rows: Iterable[dict]) -> int:
    codec, n = codec_of(path), 0
    index, entries = BlockWriter(path, codec), BlockWriter(path + ".ent", codec)
    for r in rows:
        index.write(struct.pack(">2Qd5Q", r["read_index"], r["ref_index"], r["log_prob"], r["start_contig_ref"], r["start_index_ref"], r["start_contig_read"], r["start_index_read"], entries.tell() // 5))
        for e in r["events"]:
            if e["type"] not in EVENTS:
                raise ValueError(f"unknown event {e['type']!r}")
            entries.write(e["type"].encode() + struct.pack(">I", e["n"]))
        n += 1
    index.close()
    entries.close()
    return n


def alignments_size(path: str) -> int:
    index = BlockReader(path, codec_of(path))
    try:
        if index.size() % 64:
            raise ValueError("index is truncated")
        return index.size() // 64
    finally:
        index.close()


# ---- matrices and simulated loadings


def pack_matrix(rows: list[list[float]]) -> bytes:
    return struct.pack(">2Q", len(rows), len(rows[0]) if rows else 0) + b"".join(struct.pack(f">{len(r)}d", *r) for r in rows)


def unpack_matrix(data: bytes) -> list[list[float]]:
    n, m = struct.unpack_from(">2Q", data)
    if len(data) != 16 + 8 * n * m:
        raise ValueError("truncated matrix")
    return [list(struct.unpack_from(f">{m}d", data, 16 + 8 * m * i)) for i in range(n)]


LOADING_MARK = 0x0102030405060708


def pack_loadings(alleles: int, load: int, ploidies: list[int], fan: int, counts: Iterable[list[int]]) -> bytes:
    head = struct.pack(f"=4Q{len(ploidies)}QQ", LOADING_MARK, alleles, load, len(ploidies), *ploidies, fan)
    return head + b"".join(struct.pack(f"={alleles}Q", *c) for c in counts)


def unpack_loadings(data: bytes) -> tuple[int, int, list[int], int, list[list[int]]]:
    mark, alleles, load, n = struct.unpack_from("=4Q", data)
    if mark != LOADING_MARK:
        raise ValueError("a file of a machine with another byte order")
    *ploidies, fan = struct.unpack_from(f"={n + 1}Q", data, 32)
    at = 40 + 8 * n
    return alleles, load, ploidies, fan, [list(struct.unpack_from(f"={alleles}Q", data, k)) for k in range(at, len(data), 8 * alleles)]
