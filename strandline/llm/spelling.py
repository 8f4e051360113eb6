"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point.

Words are counted inside ``mapInArrow``.  Two words at distance one share the first half of the longer one's letters or the
rest of it, so every word is filed under four keys (its first and last part, seen as the longer and as the shorter of a
pair), and a pair of near words meets under one of them.  Under a key the words are dealt into tiles.  A tile is a padded
matrix of code points, aligned left for common prefixes and right for common suffixes; two tiles are compared whole, and a
pair is near where prefix and suffix together reach the longer length minus one.

Memory: a task holds a tile or two (1,024 words each) and their pair matrices, or pieces of text of a few MB; a text of any
length is counted piece by piece.  Work under one key grows with the square of its words, divided over tasks by pairs of tiles.

Edge cases: null and empty texts have no words; a null ``doc_id`` counts as empty text; repeated rows and ids count every
time; ties of the most frequent near word go to the smallest in code-point order; an empty table has no rows; other columns
of the documents are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textkit import batch_bytes, distinct, pieces, slices, span_keys, spans, stored

#: Words of a tile.
TILE = 1024
#: Blocks of fewer words are compared several at once, pair by pair.
STACK = 48
#: Pairs of stacked blocks that are compared at once.
PAIRS = 1 << 18
#: One occurrence in so many (by hash) is written with a letter deleted.
DELETE = 97
MIN_LETTERS, MIN_COUNT = 5, 3
#: A form has at least so many times the occurrences of its variant.
FORM_RATIO = 2

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True  # 0xC3 leads U+00C0 to U+00FF


def _zero_step() -> np.ndarray:
    """What a byte of zeros does to a CRC-32 register, by its low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


STEP = _zero_step()


def prefixed_crcs(prefixes: np.ndarray, owner: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of prefix + word, from the CRC-32 of each prefix, each row's prefix number, its word's CRC-32 and length in bytes."""
    out = np.zeros(len(owner), dtype=np.uint32)
    order = np.argsort(sizes, kind="stable")
    bounds = np.searchsorted(sizes[order], np.unique(sizes), side="left").tolist() + [len(order)]
    register, at = prefixes.astype(np.uint32), 0
    for size, low, high in zip(np.unique(sizes).tolist(), bounds, bounds[1:], strict=False):
        for _ in range(size - at):
            register = STEP[register & np.uint32(0xFF)] ^ (register >> np.uint32(8))
        at = size
        rows = order[low:high]
        out[rows] = register[owner[rows]] ^ words[rows]
    return out


def count_piece(ids: list[str], texts: list[bytes]) -> Counter:
    """Occurrences of each word, with its deleted letters, over some pieces of text."""
    raw = b"\n".join([*texts, b""]).translate(_LOWER)
    data = np.frombuffer(raw, dtype=np.uint8)
    member = LETTER[data]
    member[1:] |= data[:-1] == 0xC3
    starts, ends = spans(member)
    tails = np.append(0, np.cumsum((data & 0xC0) == 0x80))
    letters = ends - starts - (tails[ends] - tails[starts])
    long = letters >= MIN_LETTERS
    starts, ends, letters = starts[long], ends[long], letters[long]
    if not len(starts):
        return Counter()
    first, number = distinct(*span_keys(raw, starts, ends))
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    crcs = np.fromiter((zlib.crc32(w) for w in words), dtype=np.uint32, count=len(words))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    prefixes = np.fromiter((zlib.crc32(f"{i}:".encode()) for i in ids), dtype=np.uint32, count=len(ids))
    h = prefixed_crcs(prefixes, owner, crcs[number], (ends - starts))
    hit = np.flatnonzero(h % np.uint32(DELETE) == 0)
    plain = np.bincount(number, minlength=len(words)) - np.bincount(number[hit], minlength=len(words))
    found = Counter({words[k].decode(): n for k, n in enumerate(plain.tolist()) if n})
    for k, at in zip(number[hit].tolist(), (h[hit] % letters[hit]).tolist(), strict=True):
        word = words[k].decode()
        if len(word) > MIN_LETTERS:
            found[word[:at] + word[at + 1 :]] += 1
    return found


_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n) of the words with at least MIN_LETTERS letters and MIN_COUNT occurrences."""

    def run(batches):
        for batch in slices(batches, "text"):
            for ids, texts in pieces(batch.column("id").to_pylist(), batch.column("text"), LETTER):
                found = count_piece(["" if i is None else i for i in ids], texts)
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).filter("text is not null").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _keys() -> Column:
    """The keys of a word: the longest length of its pair, the side and the shared part."""
    out = []
    for longest in (F.length("word"), F.length("word") + 1):
        half = F.expr("length(word) div 2") if not out else F.expr("(length(word) + 1) div 2")
        out.append(F.struct(longest.alias("longest"), F.lit(0).alias("side"), F.left("word", half).alias("part")))
        out.append(F.struct(longest.alias("longest"), F.lit(1).alias("side"), F.right("word", longest - half).alias("part")))
    return F.explode(F.array(*out))


ENTRY = "array<struct<rank: bigint, word: string>>"


def tile_pairs(words: DataFrame) -> DataFrame:
    """(longest, side, a, b) of every two tiles under one key; b is null for a tile with itself."""
    key = ["longest", "side", "part"]
    filed = words.select("word", "n", _keys().alias("key")).select("word", "n", "key.*").filter((F.col("side") == 0) | (F.length("part") > 0))
    sizes = filed.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    dealt = filed.join(sizes, key).withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    dealt = dealt.withColumn("tile", F.expr("pmod(xxhash64(word), tiles)").cast("int"))
    # the most frequent first, ties in code-point order: the first near word of a tile is the best one
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), F.col("word").alias("word"))))
    tiles = stored(dealt.groupBy(*key, "tile").agg(entries.alias("a"), F.first("tiles").alias("tiles")))
    own = tiles.select("longest", "side", "a", F.lit(None).cast(ENTRY).alias("b"))
    many = tiles.filter("tiles > 1").select(*key, "tile", "a")
    other = many.select(*key, F.col("tile").alias("tile_b"), F.col("a").alias("b"))
    return own.unionByName(many.join(other, key).filter("tile < tile_b").select("longest", "side", "a", "b"))


class Block:
    """Words as matrices of code points, aligned left and right; no letter is U+0000, which fills them."""

    def __init__(self, words: pa.Array, longest: int):
        texts = words.to_pylist()
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = np.uint8 if not len(flat) or flat.max() < 256 else np.uint16 if flat.max() < 1 << 16 else np.uint32
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        row = np.repeat(np.arange(len(texts)), self.size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.left, self.right = np.zeros((2, len(texts), longest), dtype=kind)
        self.left[row, at] = flat
        self.right[row, at + np.repeat(longest - self.size, self.size)] = flat


def _common(pairs: Iterator[np.ndarray], shape: tuple, known: int) -> np.ndarray:
    """Length of the common prefix of each pair, from matrices that tell where the letters of one place agree."""
    alive, total = np.ones(shape, dtype=bool), np.full(shape, known, dtype=np.int32 if known > 100 else np.uint8)
    for equal in pairs:
        alive &= equal
        if not alive.any():
            break
        if total.dtype == np.uint8 and int(total.max()) == 255:
            total = total.astype(np.int32)
        total += alive
    return total


def near_dense(a: Block, b: Block, longest: int, side: int) -> np.ndarray:
    """Which words of two tiles under one key are near."""
    half = longest // 2
    first, last = (half, 0) if side == 0 else (0, longest - half)
    shape = (len(a.size), len(b.size))
    prefix = _common((a.left[:, k, None] == b.left[None, :, k] for k in range(first, longest)), shape, first)
    suffix = _common((a.right[:, k, None] == b.right[None, :, k] for k in range(longest - 1 - last, -1, -1)), shape, last)
    short = a.size < longest
    near = prefix.astype(np.int32) + suffix >= longest - 1
    near &= ~(short[:, None] & (b.size < longest)[None, :])
    if side:  # those that share the first half are found under it
        near &= prefix < half
    return near


def near_stacked(block: Block, i: np.ndarray, j: np.ndarray, longest: int, side: int) -> np.ndarray:
    """The same for listed pairs of rows."""
    half = longest // 2
    differ = block.left[i] != block.left[j]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
    differ = (block.right[i] != block.right[j])[:, ::-1]
    suffix = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
    near = (prefix + suffix >= longest - 1) & (i != j) & ((block.size[i] == longest) | (block.size[j] == longest))
    return near & (prefix < half) if side else near


def _rows(words: pa.Array, ranks: pa.Array, of: np.ndarray, n: np.ndarray, others: pa.Array, other_ranks: pa.Array, best: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words.take(pa.array(of)), pa.array(n.astype(np.int64)), other_ranks.take(pa.array(best)), others.take(pa.array(best))], names=["word", "n_near", "rank", "best"])


def _stacked(batch: pa.RecordBatch, rows: np.ndarray, longest: int, side: int) -> Iterator[pa.RecordBatch]:
    entries = batch.column("a").take(pa.array(rows))
    size = np.diff(entries.offsets.to_numpy()).astype(np.int64)
    flat = entries.flatten()
    words, ranks = flat.field("word"), flat.field("rank")
    block = Block(words, longest)
    begin = np.cumsum(size) - size
    width = np.repeat(size, size)  # of each word's block
    total = np.append(0, np.cumsum(width))
    low = 0
    while low < len(width):
        high = max(low + 1, int(np.searchsorted(total, total[low] + PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(low, high), width[low:high])
        j = np.arange(len(i)) - np.repeat(total[low:high] - total[low], width[low:high]) + np.repeat(np.repeat(begin, size)[low:high], width[low:high])
        good = near_stacked(block, i, j, longest, side)
        i, j = i[good], j[good]
        of, first, n = np.unique(i, return_index=True, return_counts=True)
        if len(of):
            yield _rows(words, ranks, of, n, words, ranks, j[first])
        low = high


def _tiled(a: pa.StructArray, b: pa.StructArray | None, longest: int, side: int) -> Iterator[pa.RecordBatch]:
    left = Block(a.field("word"), longest)
    right = left if b is None else Block(b.field("word"), longest)
    near = near_dense(left, right, longest, side)
    if b is None:
        np.fill_diagonal(near, False)
    for x, y, hits in [(a, a if b is None else b, near)] + ([] if b is None else [(b, a, near.T)]):
        n = hits.sum(axis=1)
        of = np.flatnonzero(n)
        if len(of):
            yield _rows(x.field("word"), x.field("rank"), of, n[of], y.field("word"), y.field("rank"), hits[of].argmax(axis=1))


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, rank, best) of the words of each pair of tiles that have near words there."""
    for batch in batches:
        longest, side = (batch.column(c).to_numpy() for c in ("longest", "side"))
        size = batch.column("a").value_lengths().to_numpy()
        alone = batch.column("b").is_null().to_numpy(zero_copy_only=False)
        small = alone & (size <= STACK)
        for key in np.unique(longest[small] * 2 + side[small]).tolist():
            yield from _stacked(batch, np.flatnonzero(small & (longest * 2 + side == key)), key // 2, key % 2)
        for k in np.flatnonzero(~small).tolist():
            a, b = (batch.column(c).slice(k, 1) for c in ("a", "b"))
            yield from _tiled(a.flatten(), None if alone[k] else b.flatten(), int(longest[k]), int(side[k]))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, rank, best): how many words are near, and the most frequent of them with minus its occurrences."""
    found = tile_pairs(words).mapInArrow(compare, "word string, n_near long, rank long, best string")
    best = F.min(F.struct("rank", "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select("word", "n_near", "top.rank", "top.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without cycles: forms are followed to the last, twice as far in every round."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = now.filter("moved").limit(1).count()
        now = now.select("word", "root")
        if not moved:
            return now


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; see the module."""
    spark = docs.sparkSession
    with batch_bytes(spark):
        words = stored(word_counts(docs, text, doc_id))
    with batch_bytes(spark, 4 << 20):
        near = near_words(words)
        is_form = -F.col("rank") >= FORM_RATIO * F.col("n")
        told = words.join(near, "word", "left").select(
            "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("rank")).alias("form_n")
        )
        told = stored(told)
    found = told.join(roots(told.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


