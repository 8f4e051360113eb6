"""NumPy kernels over batches of UTF-8 texts, used inside ``mapInArrow``.

A batch of texts becomes one byte buffer in which every text is followed by a newline, so that no
word crosses a text.  Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.

A span of bytes (a word, a line, a unit) has a key of 128 bits: up to 15 bytes the bytes themselves and their
number, beyond that a BLAKE2b digest of 120 bits.  Equal keys mean equal bytes, in every batch; ``distinct``
compares whole keys.  ``span_hashes`` shortens a key to 64 well-mixed bits where a collision only costs a
count in 2^64 or is checked later.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: MASK[n] keeps the first n bytes of a little-endian number.
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)
#: Longest span whose key is its own bytes.
PLAIN = 15
#: Bytes of text after which a task gives freed memory back.
TRIM = 16 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants that follow from the seed."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


class Texts:
    """The words of a batch of texts (None counts as empty)."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        parts = [t or b"" for t in texts]
        self.count = len(parts)
        lengths = np.fromiter((len(t) for t in parts), dtype=np.int64, count=len(parts))
        self.end = np.cumsum(lengths + 1) - 1
        self.begin = self.end - lengths
        self.raw = b"\n".join([*parts, b""])
        if lower:
            self.raw = self.raw.lower()
        self.bytes = np.frombuffer(self.raw, dtype=np.uint8)
        self._keys: tuple | None = None
        blank = SPACE[self.bytes]
        before = np.empty_like(blank)
        if len(blank):
            before[0] = True
            before[1:] = blank[:-1]
        self.starts = np.flatnonzero(~blank & before)
        self.ends = np.flatnonzero(blank & ~before)
        if len(before) and not before[0]:
            self.ends = self.ends[1:]
        #: words[i]:words[i + 1] are the words of text i
        self.words = np.append(np.searchsorted(self.starts, self.begin), len(self.starts))
        self.n_words = np.diff(self.words)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        if self._keys is None:
            self._keys = span_keys(self.raw, self.starts, self.ends)
        return self._keys

    def hashes(self) -> np.ndarray:
        return blend(*self.keys())

    def ids(self) -> np.ndarray:
        """Words numbered within the batch: equal numbers, equal words."""
        return distinct(*self.keys())[1]

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.count), self.n_words)


def span_keys(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of raw[starts[i]:ends[i]] as two arrays of 64-bit numbers."""
    eights = np.ndarray((len(raw) + 9,), "<u8", raw + bytes(16), strides=(1,))
    size = ends - starts
    low = eights[starts] & MASK[np.minimum(size, 8)]
    high = (eights[starts + 8] & MASK[np.clip(size - 8, 0, 7)]) | (size.astype(U64) << U64(56))
    long = np.flatnonzero(size > PLAIN)
    if len(long):
        digests = [hashlib.blake2b(raw[a:b], digest_size=PLAIN).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        both = np.frombuffer(b"\xff".join([*digests, b""]), "<u8").reshape(-1, 2)
        low[long], high[long] = both[:, 0], both[:, 1]
    return low, high


def blend(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64 bits of a key; with ``high`` they determine the key."""
    return mix(low ^ mix(high))


def span_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return blend(*span_keys(raw, starts, ends))


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct row of some 64-bit columns, and each row's number among these; compares whole rows."""
    short = columns[0]
    for c in columns[1:]:
        short = blend(short, c)
    _, first, back = np.unique(short, return_index=True, return_inverse=True)
    if len(columns) > 1 and any((c[first][back] != c).any() for c in columns):  # different rows share the 64 bits
        _, first, back = np.unique(np.stack([c.view(np.int64) for c in columns], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, back.reshape(-1)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words (of the whole text where it has fewer) and their bounds by text."""
    n = np.diff(bounds)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    out_bounds = np.append(0, np.cumsum(count))
    at = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1] - bounds[:-1], count)
    stop = np.repeat(bounds[1:], count)
    total = np.zeros(len(at), dtype=U64)
    padded = np.append(words, np.zeros(size, dtype=U64))
    for k, c in enumerate(constants(77, size)):
        total += np.where(at + k < stop, padded[at + k] * c + U64(1), U64(0))
    return mix(total), out_bounds


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (one row at least).

    What the work on them has freed goes back to the system from time to time and at the end of the task.
    """
    since = 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        i = 0
        while i < len(sizes):
            done = int(total[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(i, j - i)
            since += int(total[j - 1]) - done
            i = j
            if since > TRIM:
                give_back()
                since = 0
    give_back()


def spans(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(member.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def pieces(ids: list, texts: pa.Array, member: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of about ``limit`` bytes; longer texts are cut where no run of ``member`` bytes (and those from 0x80) is cut."""
    held: list = []
    total = 0
    for i, x in zip(ids, texts, strict=True):
        value = b"" if not x.is_valid else x.as_buffer()
        size, at = len(value) if x.is_valid else 0, 0
        view = memoryview(value)
        while True:
            stop = min(size, at + limit - total) if size > limit else size
            while stop < size:
                ahead = np.frombuffer(view[stop : stop + 65_536], dtype=np.uint8)
                free = np.flatnonzero(~(member[ahead] | (ahead >= 0x80)))
                if len(free):
                    stop += int(free[0])
                    break
                stop += len(ahead)
            held.append((i, bytes(view[at:stop])))
            total += stop - at
            at = stop
            if total >= limit:
                yield [k for k, _ in held], [t for _, t in held]
                held, total = [], 0
            if at >= size:
                break
    if held:
        yield [k for k, _ in held], [t for _, t in held]


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def one_row(ddl: str, values: list) -> pa.RecordBatch:
    """A batch of a single row of plain columns, named and typed as in a Spark schema."""
    names, kinds = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([x], ARROW[k]) for x, k in zip(values, kinds, strict=True)], names=list(names))


def gather(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``pick`` of a ragged array, as a flat array and its offsets."""
    size = offsets[pick + 1] - offsets[pick]
    out = np.append(0, np.cumsum(size))
    index = np.arange(out[-1])
    index += np.repeat(offsets[:-1][pick] - out[:-1], size)
    return values[index], out


def give_back() -> None:
    """Returns freed memory to the system where the C library can; workers live long and share an executor."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@contextmanager
def batch_bytes(spark, limit: int = 16 << 20):
    """While this lasts, Arrow batches to Python have about ``limit`` bytes at most."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_dir(spark) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark)
    return f"{top.rstrip('/')}/strandline-{uuid.uuid4().hex}"


def _own_dir(spark) -> str:
    """Where spark.checkpoint.dir is unset: a folder of this machine, which is only right if all tasks run on it."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = os.path.join(tempfile.gettempdir(), "strandline-checkpoints")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


#: Tables that this process has stored and not cleared.
_stored: list[str] = []


def stored(df, codec: str = "zstd", **options: str):
    """Write a frame to a Parquet table in the shared folder and read it back: this cuts its lineage.

    The table stays until ``clear_stored``, as frames that read it are lazy.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).options(**options).parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark) -> int:
    """Deletes all tables that this process has stored; call it when their results have been written.  Returns how many there were."""
    conf, n = spark._jsc.hadoopConfiguration(), len(_stored)
    while _stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
