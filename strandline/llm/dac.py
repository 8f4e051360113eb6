"""Token ids as directly addressable codes: a binary format with random access to any token.

A shard holds the ids of some documents.  Every id is cut into chunks of ``BITS`` bits, least first.
Level 0 has the first chunk of every id, level k the (k+1)-th chunk of those ids that have one; each
level has a bitmap with a one where the id goes on at the next level, and a rank directory with the
number of ones before every block of ``BLOCK`` bits.  Token i is read from one byte of each level:
its place at the next level is the rank of its bit.  No block is decoded for that.

On disk a shard of about ``SHARD_IDS`` ids is one row of an uncompressed Parquet table, and the chunks (c0 .. c3), bitmaps
(b0 ..) and ranks (r0 ..) of its levels are columns of bytes, each value on a page of its own.  ``token_at`` asks for
single bytes of them, level by level, by (part, shard): columns of other levels and pages of other shards are not read,
and what is read needs no unpacking.

Files are written in ascending doc_id order: the rows are range-partitioned and sorted by doc_id, and by the text where
that ties, and each partition writes its shards to a table in the shared folder, with a directory of its documents.  All
columns of a query are read back from these files.

Edge cases: a null text counts as empty (its end id is its only id); null ids come first; of rows that share an id, those
with the lesser hash of the text come first; repeated rows are all written; a document longer than a shard has a shard of
its own; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import UnitEncoder
from .textkit import as_bytes, slices, stored

BITS, BLOCK, SHARD_IDS = 8, 512, 1 << 16
#: Levels of an id of 32 bits.
LEVELS = 32 // BITS


def pack(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """Chunks, bitmap (least bit first) and ranks of every level of ids (unsigned 32-bit)."""
    levels = []
    rest = ids.astype(np.uint32)
    for _ in range(LEVELS):
        chunk = (rest & np.uint32((1 << BITS) - 1)).astype(np.uint8)
        more = rest >> np.uint32(BITS)
        goes = more > 0
        ones = np.add.reduceat(goes.astype(np.uint32), np.arange(0, len(goes), BLOCK)) if len(goes) else np.zeros(0, np.uint32)
        levels.append((chunk.tobytes(), np.packbits(goes, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()))
        rest = more[goes]
    return levels


def unpack(levels: list[tuple[bytes, bytes]]) -> np.ndarray:
    """All ids from the chunks and bitmaps of the levels."""
    value = np.zeros(0, dtype=np.uint32)
    for chunk, bitmap in reversed(levels):
        here = np.frombuffer(chunk, np.uint8).astype(np.uint32)
        goes = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(here), bitorder="little").astype(bool)
        here[goes] |= value << np.uint32(BITS)
        value = here
    return value


def get(read, i: int) -> int:
    """Id number i; read(level, i) gives the chunk at i, the bytes of the bitmap from i's block up to i, and the block's rank."""
    value = 0
    for level in range(LEVELS):
        chunk, bits, rank = read(level, i)
        value |= chunk << (BITS * level)
        here = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[: i % BLOCK + 1]
        if not here[-1]:
            break
        i = rank + int(here[:-1].sum())
    return value


COLUMNS = [f"{kind}{level}" for level in range(LEVELS) for kind in "cbr"]
SHARDS = "part int, shard long, n_ids long, n_docs long, n_null long, first_doc long, last_doc long, doc_ids binary, bounds binary, " + ", ".join(f"{c} binary" for c in COLUMNS)


def write_shards(docs: DataFrame, path: str, end_id: int | None = 2) -> DataFrame:
    """The table of shards of docs (doc_id, text), encoded with the tokenizer in the file ``path``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    # an id that very many rows share is dealt out by its texts
    ordered = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        encoder, part, shard = UnitEncoder.of(path), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []

        def flush():
            sizes = np.append(0, np.cumsum([len(x) for x in held]))
            real = [x for x in names if x is not None]  # null ids come first
            known = np.array([0] * (len(names) - len(real)) + real, dtype="<i8")
            row = [part, shard, int(sizes[-1]), len(names), len(names) - len(real), min(real, default=None), max(real, default=None), known.tobytes(), sizes.astype("<i8").tobytes()]
            row += [x for level in pack(np.concatenate(held)) for x in level]
            types = [pa.int32(), *[pa.int64()] * 6, *[pa.binary()] * (2 + len(COLUMNS))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in SHARDS.split(", ")])

        waiting = 0
        for b in slices(batches, limit=8 << 20):
            ids, bounds = encoder.encode(as_bytes(b.column("text")))
            for name, i, j in zip(b.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                row = ids[i:j] if end_id is None else np.append(ids[i:j], np.uint32(end_id))
                if held and waiting + len(row) > SHARD_IDS:
                    yield flush()
                    shard += 1
                    names, held, waiting = [], [], 0
                names.append(name)
                held.append(row)
                waiting += len(row)
        if held:
            yield flush()

    # pages of one value each, so that a value is found by the column index and read alone
    options = {"parquet.page.size": str(SHARD_IDS // 2), "parquet.page.row.count.limit": "1", "parquet.enable.dictionary": "false"}
    return stored(ordered.mapInArrow(run, SHARDS), "uncompressed", **options)


def token_at(shards: DataFrame, doc_id: int, k: int) -> int | None:
    """Token k of a document (the first with that id, in the order of the files), by single bytes of the stored levels."""
    near = shards.filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("part", "shard", "n_null", "doc_ids", "bounds")
    for row in near.orderBy("part", "shard").toLocalIterator():
        at = np.flatnonzero(np.frombuffer(row.doc_ids, "<i8") == doc_id)
        at = at[at >= row.n_null]
        if len(at):
            bounds = np.frombuffer(row.bounds, "<i8")
            if not 0 <= k < bounds[at[0] + 1] - bounds[at[0]]:
                return None
            one = shards.filter((F.col("part") == row.part) & (F.col("shard") == row.shard))
            return get(lambda level, i: read_bytes(one, level, i), int(bounds[at[0]]) + k)
    return None


def read_bytes(shard: DataFrame, level: int, i: int) -> tuple[int, bytes, int]:
    """What ``get`` needs of a level, from one row of the table."""
    block = i // BLOCK
    piece = lambda name, at, size: F.substring(F.col(f"{name}{level}"), at + 1, size)
    chunk, bits, rank = shard.select(piece("c", i, 1), piece("b", block * BLOCK // 8, i // 8 - block * BLOCK // 8 + 1), piece("r", 4 * block, 4)).first()
    return chunk[0], bytes(bits), int.from_bytes(rank, "little")


def read_digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # one row for each partition of the writer, in one task: sums of sizes, no documents
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    starts = shards.select("part", "shard", "n_ids").withColumn("inside", inside).join(before, "part")
    starts = starts.select("part", "shard", (F.col("before") + F.col("inside")).alias("base"))
    codes = [c for c in COLUMNS if c[0] != "r"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a shard at a time
                b = batch.slice(i, 1)
                row = {c: b.column(c)[0].as_py() for c in b.schema.names}
                ids = unpack([(row[f"c{level}"], row[f"b{level}"]) for level in range(LEVELS)]).astype("<u4")
                at, names = np.frombuffer(row["bounds"], "<i8"), np.frombuffer(row["doc_ids"], "<i8")
                sums = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                missing = np.arange(len(names)) < row["n_null"]
                part, shard = np.full(len(names), row["part"], np.int32), np.full(len(names), row["shard"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(shard), pa.array(names, pa.int64(), mask=missing), pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    # codes stay where they are; only digests meet the starts of their shards
    digests = shards.select("part", "shard", "n_null", "doc_ids", "bounds", *codes).mapInArrow(run, "part int, shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return digests.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
