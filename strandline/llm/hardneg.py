"""Hard negatives: rows of another label whose score lies a little below that of an anchor's positives.

Vectors are scaled to integers and laid out once in blocks, a table row each.  Anchors (a fixed share of the rows) are packed
into blocks of their own; every block of anchors meets every block of rows through an equi-join on (shard, group), so a task
holds one block of each and the best scores of a group of anchors.  Two passes: the best rows of the same label, then, with their
scores known, the best rows of other labels within each positive's window.

Scores are exact products of packed integers.  Components are biased to be non-negative; those of several candidates go into
separate fields of one wide integer, wide enough for a whole sum, so one multiplication by an anchor's component serves
all of them, and the sums are read from the fields.  Wide integers of up to 53 bits are held in doubles, in which every sum is
exact, and multiplied as matrices; where one field needs more, they are Python integers.

Work grows with rows times anchors.  Data moved: blocks once for each group of 32,768 anchors, anchors once for each of 64 shards.

Edge cases: rows with a null id, label or vector or with a null or non-finite component take no part; shorter vectors count as
padded with zeros; repeated rows are rows of their own (an anchor's copy is another row); ties go to the smaller id; an anchor
without positives, and a positive without a negative, give no row; an empty table gives none; other columns are not read.
Scores beyond 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import batch_bytes, give_back, one_row, stored

#: Rows and components of a block at most.
ROWS, COMPONENTS = 4096, 1 << 22
#: Anchors of a block, and of a group whose best scores a task holds.
ANCHORS, GROUP = 1024, 32_768
#: Shards of the rows; every group of anchors is sent to each.
SHARDS = 64
#: Fields of a Python integer.
FIELDS = 16
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Bounds of a negative's score as percentages of the positive's.
LOW, HIGH = 50, 95
ANCHOR_EVERY = 50
NONE = np.iinfo(np.int64).min


def scaled(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components as integers and their offsets by row, and which rows take part."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False)  # null becomes NaN
    with np.errstate(over="ignore", invalid="ignore"):
        numbers = np.floor(SCALE * values)
    bad = np.append(0, np.cumsum(~np.isfinite(numbers)))
    ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    numbers[~np.isfinite(numbers)] = 0
    if len(numbers) and np.abs(numbers).max() >= 1 << 62:
        raise OverflowError("scores beyond 64 bits")
    return numbers.astype(np.int64), offsets, ok


def matrix(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray, width: int) -> np.ndarray:
    """Rows ``pick`` as a matrix, padded with zeros."""
    size = offsets[pick + 1] - offsets[pick]
    out = np.zeros((len(pick), width), dtype=np.int64)
    row = np.repeat(np.arange(len(pick)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[row, at] = values[np.repeat(offsets[:-1][pick], size) + at]
    return out


BLOCK = "block long, n int, width int, low long, high long, anchors int, kind string, ids binary, labels binary, parts binary"


def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (vec_id, label, vector), components in the smallest kind of integer that holds them."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        values, offsets, ok = scaled(batch.column("vector"))
        rows = np.flatnonzero(ok)
        size = np.diff(offsets)
        step = int(np.clip(COMPONENTS // max(1, size.max(initial=1)), 16, ROWS))
        for k in range(0, len(rows), step):
            pick = rows[k : k + step]
            own = ids[pick].astype(np.int64)
            label = labels[pick].astype(np.int64)
            label = np.where(own % 7 == 0, np.fmod(label + 1, 10), label)
            parts = matrix(values, offsets, pick, int(size[pick].max()))
            low, high = min(0, int(parts.min(initial=0))), max(0, int(parts.max(initial=0)))
            kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
            made = [number, len(pick), parts.shape[1], low, high, int((own % ANCHOR_EVERY == 0).sum()), kind, own.tobytes(), label.tobytes(), parts.astype(kind).tobytes()]
            yield one_row(BLOCK, made)
            number += 1
    give_back()


def unpack(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and components of a block, padded to ``width``."""
    parts = np.frombuffer(row["parts"], dtype=row["kind"]).reshape(row["n"], row["width"]).astype(np.int64)
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["labels"], dtype=np.int64), np.pad(parts, ((0, 0), (0, width - row["width"])))


def field_bits(width: int, low: int, high: int) -> int:
    """Bits of a sum of ``width`` products of biased components."""
    return max(1, (max(1, width) * (high - low) ** 2).bit_length())


def products(a: np.ndarray, b: np.ndarray, low: int, high: int) -> np.ndarray:
    """Inner products of the rows of two integer matrices whose components lie in [low, high]."""
    width = a.shape[1]
    bits = field_bits(width, low, high)
    exact = bits <= 53
    fields = 53 // bits if exact else FIELDS
    kind = np.float64 if exact else object
    each = -(-len(b) // fields)  # candidates of a field
    biased = np.zeros((fields * each, width), dtype=kind)
    biased[: len(b)] = (b - low).astype(kind) if exact else (b.astype(object) - low)
    wide = biased[:each].copy()
    for f in range(1, fields):
        wide += biased[f * each : (f + 1) * each] * (2.0 ** (bits * f) if exact else 1 << (bits * f))
    left = (a - low).astype(kind) if exact else a.astype(object) - low
    packed = left @ wide.T
    if exact:
        packed = packed.astype(np.int64)
    mask = (1 << bits) - 1
    out = np.concatenate([(packed >> (bits * f)) & mask for f in range(fields)], axis=1)[:, : len(b)]
    # a.b from (a - low).(b - low)
    add_a, add_b = low * left.sum(axis=1), low * biased[: len(b)].sum(axis=1)
    if exact:
        return out + add_a.astype(np.int64)[:, None] + add_b.astype(np.int64)[None, :] + width * low * low
    out = out + add_a[:, None] + add_b[None, :] + width * low * low
    if out.size and max(abs(int(out.min())), abs(int(out.max()))) >= 1 << 63:
        raise OverflowError("scores beyond 64 bits")
    return out.astype(np.int64)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest of each row, the first of equals first; NONE is no value.  Overwrites scores."""
    rows = np.arange(len(scores))
    at, value = np.zeros((2, len(scores), k), dtype=np.int64)
    value[:] = NONE
    for n in range(min(k, scores.shape[1])):
        at[:, n] = scores.argmax(axis=1)
        value[:, n] = scores[rows, at[:, n]]
        scores[rows, at[:, n]] = NONE
    return at, value


class Tops:
    """The best (score, id) of rows of slots, over any number of blocks."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), NONE), np.zeros((rows, k), dtype=np.int64)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        s, i = np.concatenate([self.score[rows], score], axis=1), np.concatenate([self.id[rows], ids], axis=1)
        order = np.lexsort((i, ~s), axis=1)[:, :k]  # ~s falls as s grows, and never overflows
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


PACK = "grp int, n int, ids binary, labels binary, homes binary, rows binary, parts binary, ps binary, pids binary"


def anchors_of(width: int):
    """Anchor rows of blocks: (block, row, vec_id, label, parts)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, parts = unpack(row, width)
                at = np.flatnonzero(ids % ANCHOR_EVERY == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array(labels[at]), pa.array([p.tobytes() for p in parts[at]], pa.binary())],
                    names=["block", "row", "vec_id", "label", "parts"],
                )

    return run


def pack_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors (grp, block, row, vec_id, label, parts, ps, pids), one group after the other."""
    held: list[dict] = []

    def block():
        n = len(held)
        ps, pids = np.full((n, POSITIVES), NONE), np.zeros((n, POSITIVES), dtype=np.int64)
        for k, r in enumerate(held):
            ps[k, : len(r["ps"])], pids[k, : len(r["pids"])] = r["ps"], r["pids"]
        numbers = [np.array([r[c] for r in held], dtype=np.int64).tobytes() for c in ("vec_id", "label", "block", "row")]
        made = [held[0]["grp"], n, *numbers, b"".join(r["parts"] for r in held), ps.tobytes(), pids.tobytes()]
        return one_row(PACK, made)

    for batch in batches:
        for r in batch.to_pylist():
            if held and (len(held) >= ANCHORS or held[0]["grp"] != r["grp"]):
                yield block()
                held.clear()
            held.append(r)
    if held:
        yield block()


class Anchors:
    def __init__(self, row: dict, width: int):
        self.ids, self.labels, self.homes, self.rows = (np.frombuffer(row[c], dtype=np.int64) for c in ("a_ids", "a_labels", "homes", "rows"))
        self.parts = np.frombuffer(row["a_parts"], dtype=np.int64).reshape(row["a_n"], width)
        self.ps, self.pids = (np.frombuffer(row[c], dtype=np.int64).reshape(row["a_n"], POSITIVES) for c in ("ps", "pids"))


FOUND = "block long, row int, anchor_id long, slot int, positive_id long, positive_score long, score long, id long"


def search(width: int, low: int, high: int, negatives: bool):
    """Best rows of each anchor (and positive) over the pairs of blocks that a task gets."""

    def emit(a: Anchors, tops: Tops):
        slots = POSITIVES if negatives else 1
        row, k = np.nonzero(tops.score != NONE)
        at, slot = row // slots, row % slots
        columns = [a.homes[at], a.rows[at].astype(np.int32), a.ids[at], slot.astype(np.int32), a.pids[at, slot], a.ps[at, slot], tops.score[row, k], tops.id[row, k]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])

    def run(batches):
        held: dict[tuple, tuple[Anchors, Tops]] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                key = (row["homes"], row["rows"])
                if key not in held:
                    if len(held) > GROUP // ANCHORS:  # another group
                        yield from (emit(*x) for x in held.values())
                        held.clear()
                    a = Anchors(row, width)
                    held[key] = a, Tops(len(a.ids) * (POSITIVES if negatives else 1), NEGATIVES if negatives else POSITIVES)
                _compare(*held[key], row, width, low, high, negatives)
        yield from (emit(*x) for x in held.values())
        give_back()

    return run


def _compare(a: Anchors, tops: Tops, row: dict, width: int, low: int, high: int, negatives: bool) -> None:
    ids, labels, parts = unpack(row, width)
    order = np.argsort(ids, kind="stable")  # the first of equal scores has the smallest id
    ids, labels, parts = ids[order], labels[order], parts[order]
    if not negatives:
        for label in np.unique(a.labels).tolist():
            mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(labels == label)
            if len(theirs):
                s = products(a.parts[mine], parts[theirs], low, high)
                own = (a.homes[mine] == row["block"])[:, None] & (a.rows[mine][:, None] == order[theirs][None, :])
                s[own] = NONE
                at, value = best(s, POSITIVES)
                tops.add(mine, value, ids[theirs][at])
        return
    s = products(a.parts, parts, low, high)
    s[a.labels[:, None] == labels[None, :]] = NONE
    for slot in range(POSITIVES):
        mine = np.flatnonzero(a.ps[:, slot] != NONE)
        if len(mine):
            ps = a.ps[mine, slot].astype(object)
            least, most = (np.array([f(p) for p in ps], dtype=np.int64) for f in (lambda p: -(-LOW * p // 100), lambda p: HIGH * p // 100))
            at, value = best(np.where(s[mine] <= most[:, None], s[mine], NONE), NEGATIVES)
            value[value < least[:, None]] = NONE
            tops.add(mine * POSITIVES + slot, value, ids[at])


def _pairs(blocks: DataFrame, anchors: DataFrame, shards: int, groups: int) -> DataFrame:
    """Every block with every block of anchors, dealt by shard of the blocks and group of the anchors."""
    renamed = {c: f"a_{c}" for c in ("n", "ids", "labels", "parts")}
    left = blocks.drop("low", "high", "anchors").withColumn("shard", F.expr(f"pmod(xxhash64(block), {shards})").cast("int"))
    left = left.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumnsRenamed(renamed).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    cells = 2 * shards * groups  # a number of our own: the work, not the bytes, decides how much a task gets
    return left.repartition(cells, "shard", "grp").join(right.repartition(cells, "shard", "grp"), ["shard", "grp"])


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see the module."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    with batch_bytes(spark):
        blocks = stored(rows.dropna().mapInArrow(lay_out, BLOCK))
        n, width, low, high, anchors = blocks.agg(F.count("block"), F.max("width"), F.min("low"), F.max("high"), F.sum("anchors")).first()
        width, low, high = width or 0, low or 0, high or 0
        shards, groups = max(1, min(SHARDS, n)), max(1, -(-(anchors or 0) // GROUP))
        found = blocks.filter("anchors > 0").select("block", "n", "width", "kind", "ids", "labels", "parts")
        group = F.expr(f"pmod(xxhash64(block, row), {groups})").cast("int").alias("grp")
        alone = stored(found.mapInArrow(anchors_of(width), "block long, row int, vec_id long, label long, parts binary").withColumn("grp", group))

        def packed(frame):
            frame = frame.select("grp", "block", "row", "vec_id", "label", "parts", "ps", "pids")
            return stored(frame.repartition(groups, "grp").sortWithinPartitions("grp", "block", "row").mapInArrow(pack_anchors, PACK))

        none = F.array().cast("array<bigint>")
        first = packed(alone.withColumns({"ps": none, "pids": none}))
        same = _pairs(blocks, first, shards, groups).mapInArrow(search(width, low, high, False), FOUND)
        # at most as many candidates as shards times positives meet here
        top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))), 1, POSITIVES)
        positives = same.groupBy("block", "row").agg(top.alias("top")).select("block", "row", F.transform("top.down", lambda x: -x).alias("ps"), F.col("top.id").alias("pids"))
        second = packed(alone.join(positives, ["block", "row"]))
        other = stored(_pairs(blocks, second, shards, groups).mapInArrow(search(width, low, high, True), FOUND))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))), 1, NEGATIVES)
    told = other.groupBy("block", "row", "anchor_id", "slot", "positive_id", "positive_score").agg(top.alias("top"))
    told = told.select("anchor_id", "positive_id", "positive_score", F.posexplode("top").alias("at", "x"))
    return told.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.down")).alias("negative_score"))
