"""ISO base media containers: written, walked and read without decoding a payload.

``pack`` stores a payload losslessly as 8-bit grey frames of 16 x 12 samples (192 bytes each) in a
``raw `` video track; the length of the text before padding stands in the track's user data.  ``walk`` visits nested boxes
of any such file (32- and 64-bit sizes, boxes that reach to the end, unknown boxes), and ``describe`` decodes the sample
tables of the first video track (else of the first track): stts, ctts, stsz or stz2, stsc, stco or co64, stss, the edit
list, and the fragments of a fragmented file (moof, traf, tfhd, trun with the defaults of trex).  From these it gets codec,
duration and the byte ranges and times of the key frames; the samples themselves are only copied.

Counts are checked against the bytes that are there before anything of that size is made, and boxes are walked with a
list instead of recursion, up to ``MAX_DEPTH`` levels.

Edge cases: a null text is stored as an empty one (one frame of blanks); texts up to what one binary value holds (2 GB) are
stored whole; a broken file (truncated, without a table, with impossible counts or too deep) yields ``error`` and nulls
rather than an exception; repeated rows are all stored; an empty table stays empty; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import as_bytes, slices, stored

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
#: Ticks a second and ticks a frame, frames a chunk, and each how many frames a key frame comes.
TIMESCALE, TICKS, CHUNK, KEY_EVERY = 600, 24, 16, 8
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MAX_DEPTH = 32
#: Box of the user data with the number of bytes before padding.
LENGTH = b"tlen"
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return struct.pack(">I4s", size, kind) + body if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """Blanks up to a positive multiple of a frame."""
    return data + b" " * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def pack(payload: bytes, length: int | None = None) -> bytes:
    """A file with the payload (a positive multiple of a frame) as one video track; length: of its part before padding."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK)
    rest = frames - (chunks - 1) * CHUNK
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    if chunks == 1:
        runs = [(1, rest, 1)]
    else:
        runs = [(1, CHUNK, 1)] + ([(chunks, rest, 1)] if rest != CHUNK else [])
    entry = _box(
        b"raw ",
        bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1),
        b"\x05grey8".ljust(32, b"\0") + struct.pack(">Hh", 40, -1),
    )
    wide = len(payload) + 4096 + 16 * chunks >= 1 << 32
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(base: int) -> bytes:
        offsets = np.arange(chunks, dtype=np.int64) * (CHUNK * FRAME) + base
        table = (
            _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes())
            if wide
            else _full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        )
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, TICKS)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            table,
        )
        ticks = frames * TICKS
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"grey\0")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks) + bytes(16) + MATRIX + struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3, version=1)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100) + bytes(10) + MATRIX + bytes(24) + struct.pack(">I", 2), version=1)
        udta = _box(b"udta", _box(LENGTH, struct.pack(">Q", len(payload) if length is None else length)))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf), udta))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    base = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(base) + _box(b"mdat", payload)


def walk(data: bytes):
    """(path, start, body start, body end) of every box, parents first; a box that overruns its parent is an error."""
    waiting: list[tuple[int, int, tuple]] = [(0, len(data), ())]
    while waiting:
        begin, end, path = waiting.pop()
        if begin >= end or (end - begin < 8 and path[-1:] == (b"udta",)):  # some writers end user data with a zero
            continue
        if end - begin < 8:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, begin)
        body = begin + 8
        if size == 1:
            if end - begin < 16:
                raise ValueError("truncated box header")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else begin + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} overruns its parent")
        here = (*path, kind)
        yield here, begin, body, stop
        waiting.append((stop, end, path))
        if kind in NESTED:
            if len(here) > MAX_DEPTH:
                raise ValueError("boxes nested too deep")
            waiting.append((body, stop, here))


def _table(data: bytes, at: tuple[int, int], skip: int, columns: int, kind: str = ">u4") -> np.ndarray:
    (count,) = struct.unpack_from(">I", data, at[0] + skip - 4)
    width = np.dtype(kind).itemsize
    if at[0] + skip + count * columns * width > at[1]:
        raise ValueError("truncated table")
    return np.frombuffer(data, dtype=kind, count=count * columns, offset=at[0] + skip).astype(np.int64).reshape(count, columns)


def _sizes(data: bytes, track: dict) -> np.ndarray:
    """Bytes of every sample, from stsz or stz2."""
    if b"stsz" in track:
        fixed, count = struct.unpack_from(">II", data, track[b"stsz"][0] + 4)
        if not fixed:
            return _table(data, track[b"stsz"], 12, 1)[:, 0]
        if fixed * count > len(data):
            raise ValueError("a sample lies outside the file")
        return np.full(count, fixed, dtype=np.int64)
    if b"stz2" not in track:
        raise ValueError("no stsz")
    at, stop = track[b"stz2"]
    bits, count = struct.unpack_from(">BI", data, at + 7)
    if bits not in (4, 8, 16) or at + 12 + -(-count * bits // 8) > stop:
        raise ValueError("truncated table")
    if bits == 4:
        pairs = np.frombuffer(data, np.uint8, -(-count // 2), at + 12)
        return np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1)[:count].astype(np.int64)
    return np.frombuffer(data, ">u2" if bits == 16 else np.uint8, count, at + 12).astype(np.int64)


def _runs(data: bytes, at: tuple[int, int] | None, count: int, signed: bool = False) -> np.ndarray:
    """A run-length table (stts, ctts) by sample."""
    if at is None:
        return np.zeros(count, dtype=np.int64)
    runs = _table(data, at, 8, 2)
    if runs[:, 0].sum() != count:
        raise ValueError("sample tables disagree")
    values = runs[:, 1]
    if signed and data[at[0]] == 1:
        values = np.where(values >= 1 << 31, values - (1 << 32), values)
    return np.repeat(values, runs[:, 0])


def _stored_samples(data: bytes, track: dict) -> tuple[np.ndarray, ...]:
    """Offset, size, duration, composition offset and key mark of every sample in the tables of the track."""
    sizes = _sizes(data, track)
    count = len(sizes)
    if b"co64" in track:
        chunks = _table(data, track[b"co64"], 8, 1, ">u8")[:, 0]
    elif b"stco" in track:
        chunks = _table(data, track[b"stco"], 8, 1)[:, 0]
    else:
        raise ValueError("no stco")
    spread = _table(data, track[b"stsc"], 8, 3)
    starts = np.append(spread[:, 0], len(chunks) + 1)
    if len(chunks) and (starts[0] != 1 or (np.diff(starts) < 0).any()):
        raise ValueError("sample tables disagree")
    per_chunk = np.repeat(spread[:, 1], np.diff(starts)) if len(chunks) else np.zeros(0, dtype=np.int64)
    if len(per_chunk) != len(chunks) or per_chunk.sum() != count:
        raise ValueError("sample tables disagree")
    before = np.append(0, np.cumsum(sizes))
    first = np.append(0, np.cumsum(per_chunk))[:-1]
    offsets = np.repeat(chunks - before[first], per_chunk) + before[:-1]
    key = np.ones(count, dtype=bool)
    if b"stss" in track:
        at = _table(data, track[b"stss"], 8, 1)[:, 0] - 1
        if len(at) and (at.min() < 0 or at.max() >= count):
            raise ValueError("a key frame is no sample")
        key[:] = False
        key[at] = True
    return offsets, sizes, _runs(data, track[b"stts"], count), _runs(data, track.get(b"ctts"), count, True), key


def _fragment(data: bytes, moof: int, traf: list[tuple], number: int, defaults: tuple) -> list[tuple[np.ndarray, ...]]:
    """The same of every run of a track fragment; defaults: duration, size and flags from trex."""
    out, base, (duration, size, flags) = [], moof, defaults
    at = None
    for kind, body, stop in traf:
        if kind == b"tfhd":
            given, own = struct.unpack_from(">II", data, body)
            if own != number:
                return []
            here = body + 8
            if given & 1:
                (base,) = struct.unpack_from(">Q", data, here)
                here += 8
            here += 4 * bool(given & 2)
            values = [duration, size, flags]
            for k, bit in enumerate((8, 16, 32)):
                if given & bit:
                    (values[k],) = struct.unpack_from(">I", data, here)
                    here += 4
            duration, size, flags = values
            at = base
        elif kind == b"trun":
            if at is None:
                raise ValueError("a run without a header")
            given, count = struct.unpack_from(">II", data, body)
            here = body + 8
            if given & 1:
                at = base + struct.unpack_from(">i", data, here)[0]
                here += 4
            first = None
            if given & 4:
                (first,) = struct.unpack_from(">I", data, here)
                here += 4
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if given & bit]
            if here + 4 * count * len(fields) > stop or (not given & 0x200 and (count * max(size, 1) > len(data))):
                raise ValueError("truncated table")
            table = np.frombuffer(data, ">u4", count * len(fields), here).astype(np.int64).reshape(count, len(fields))
            column = lambda bit, default: table[:, fields.index(bit)] if bit in fields else np.full(count, default, dtype=np.int64)  # noqa: B023, E731
            sizes, marks, shift = column(0x200, size), column(0x400, flags).copy(), column(0x800, 0)
            if first is not None and count:
                marks[0] = first
            if data[body] == 1:
                shift = np.where(shift >= 1 << 31, shift - (1 << 32), shift)
            offsets = at + np.append(0, np.cumsum(sizes))
            out.append((offsets[:-1], sizes, column(0x100, duration), shift, marks & 0x10000 == 0))
            at = int(offsets[-1])
    return out


def describe(data: bytes) -> dict:
    """Codec, handler, size, timescale, duration and first time shown (ticks), and offset and length of each sample, number and time of each key frame."""
    tracks: list[dict] = []
    moofs: list[tuple[int, list]] = []
    trex: dict[int, tuple] = {}
    movie_scale = 0
    for path, start, body, stop in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({})
        elif kind == b"moof":
            moofs.append((start, []))
        elif kind == b"traf" and moofs:
            moofs[-1][1].append([])
        elif kind == b"trex":
            trex[struct.unpack_from(">I", data, body + 4)[0]] = struct.unpack_from(">III", data, body + 12)
        elif kind == b"mvhd":
            (movie_scale,) = struct.unpack_from(">I", data, body + (20 if data[body] == 1 else 12))
        if tracks and b"trak" in path:
            tracks[-1].setdefault(kind, (body, stop))
        if b"traf" in path[:-1] and moofs and moofs[-1][1]:
            moofs[-1][1][-1].append((kind, body, stop))
    if not tracks:
        raise ValueError("no track")
    handler = lambda t: bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12])
    track = next((t for t in tracks if b"hdlr" in t and handler(t) == b"vide"), tracks[0])
    for need in (b"hdlr", b"mdhd", b"stsd", b"stts", b"stsc", b"tkhd"):
        if need not in track:
            raise ValueError(f"no {need.decode()}")
    at = track[b"mdhd"][0]
    (timescale,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
    at = track[b"tkhd"][0]
    (number,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
    at = track[b"stsd"][0] + 8
    codec = bytes(data[at + 4 : at + 8]).decode("latin-1")
    video = handler(track) == b"vide"
    width, height = struct.unpack_from(">HH", data, at + 32) if video else (0, 0)
    parts = [_stored_samples(data, track)]
    for start, trafs in moofs:
        for traf in trafs:
            parts += _fragment(data, start, traf, number, trex.get(number, (0, 0, 0)))
    offsets, sizes, ticks, shift, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(offsets) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("a sample lies outside the file")
    shown = np.append(0, np.cumsum(ticks))[:-1] + shift
    keys = np.flatnonzero(key)
    duration, first = int(ticks.sum()), int(shown.min()) if len(shown) else 0
    if b"elst" in track:  # what is shown, in ticks of the movie
        wide = data[track[b"elst"][0]] == 1
        (count,) = struct.unpack_from(">I", data, track[b"elst"][0] + 4)
        if track[b"elst"][0] + 8 + count * (20 if wide else 12) > track[b"elst"][1]:
            raise ValueError("truncated table")
        edits = [struct.unpack_from(">Qq" if wide else ">Ii", data, track[b"elst"][0] + 8 + k * (20 if wide else 12)) for k in range(count)]
        used = [e for e in edits if e[1] >= 0]
        if used and movie_scale:
            total = sum(e[0] for e in edits)
            first, duration = used[0][1], total * timescale // movie_scale if total else duration - used[0][1]
    length = struct.unpack_from(">Q", data, track[LENGTH][0])[0] if LENGTH in track else None
    return {"codec": codec, "handler": handler(track).decode("latin-1"), "width": width, "height": height, "timescale": timescale, "duration": duration, "first": first, "offsets": offsets, "sizes": sizes, "keys": keys, "key_times": shown[keys], "length": length}


def samples(data: bytes, seen: dict) -> bytes:
    """The samples' bytes in order; neighbouring ranges are copied as one."""
    o, s = seen["offsets"], seen["sizes"]
    if not len(o):
        return b""
    cut = np.append(0, np.flatnonzero(o[1:] != o[:-1] + s[:-1]) + 1)
    last = np.append(cut[1:], len(o)) - 1
    return b"".join(data[a:b] for a, b in zip(o[cut].tolist(), (o[last] + s[last]).tolist(), strict=True))


PACKED = "doc_id long, media binary"
READ = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    + [("codec", pa.string()), ("duration_s", pa.float64()), ("key_offsets", pa.list_(pa.int64())), ("key_lengths", pa.list_(pa.int64())), ("key_times", pa.list_(pa.int64())), ("error", pa.string())]
)
READ_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, key_offsets array<long>, key_lengths array<long>, key_times array<long>, error string"


def pack_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text, padded, in a container."""

    def run(batches):
        for b in slices(batches):
            texts = [t or b"" for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([pack(pad(t), len(t)) for t in texts], type=pa.binary())], names=["doc_id", "media"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, PACKED)


def read_row(data: bytes | None) -> tuple:
    """The columns of READ after doc_id, for one stored file."""
    if data is None:
        return (*[None] * 12, "no file")
    digest = hashlib.sha256(data).hexdigest()
    try:
        seen = describe(data)
    except (ValueError, struct.error, IndexError) as e:
        return (None, None, None, None, len(data), digest, *[None] * 6, str(e))
    payload = samples(data, seen)
    o, s = seen["offsets"][seen["keys"]], seen["sizes"][seen["keys"]]
    ranges = zlib.crc32(np.stack([o, s], axis=1).astype("<i8").tobytes())
    feature = f"{seen['handler']}/{seen['codec'].strip()} {seen['width']}x{seen['height']} {seen['duration']}/{seen['timescale']} samples {len(seen['sizes'])} keys {len(o)} ranges {ranges:08x}"
    numbers = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), digest, feature)
    return (seen["length"], *numbers, seen["codec"], seen["duration"] / max(1, seen["timescale"]), o.tolist(), s.tolist(), seen["key_times"].tolist(), None)


def read_media(files: DataFrame) -> DataFrame:
    """Reads (doc_id, media) back: payload digests, codec, duration and key frames' ranges."""

    def run(batches):
        for b in slices(batches, "media"):
            rows = list(zip(*map(read_row, b.column("media").to_pylist()), strict=True)) or [()] * (len(READ) - 1)
            arrays = [pa.array(list(v), type=f.type) for v, f in zip(rows, list(READ)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], schema=READ)

    return files.select("doc_id", "media").mapInArrow(run, READ_SCHEMA)


def media_columns(docs: DataFrame) -> DataFrame:
    """Every text stored as a container in a table in the shared folder, and described from the stored bytes."""
    return read_media(stored(pack_texts(docs)))
