"""BPE encoding and decoding with content-defined chunk reuse.

``UnitEncoder`` encodes texts exactly as the tokenizers library does.  A text is cut before every run
of blanks (bytes 0x20, 0x09-0x0D) into units "blanks + word"; no pre-token of the supported kinds of
tokenizers crosses such a cut, so equal units have equal ids wherever they stand, and each distinct
unit is given to the library once per worker (a cache of at most ``CACHE`` units, found by their whole
128-bit keys, see ``textkit``).  Texts in which that could fail (other Unicode blanks next to the regular
ones, where the pre-tokenizer sees blanks) are given to the library whole.

Chunk reuse over documents: a rolling hash over the last bytes of every unit ends a chunk where its
low bits are zero, so equal passages give equal chunks whatever stands before them.
 1. Chunk keys are counted; those that occur twice set a bit in a bitmap sized by their number.
 2. Every document is cut once more.  Where less than ``MIN_SHARED`` of its units lie in shared chunks, moving their codes
    would cost more than they save, and the document is encoded at once.  Of every other document only the ids of its own
    chunks are stored, the keys of its shared chunks and, once a task, the shared chunks themselves; every shared chunk is
    encoded once.
 3. At each joint of two chunks the units around it are encoded together; where that differs from their own ids, the
    document is assembled at once, and ``_repair`` doubles the window until its ends agree with both chunks' own ids (at
    last, both chunks whole).
 4. The codes go back to the documents that use them and are put between their own ids.
False positives of the bitmap only send more documents the longer way.

Edge cases: a null text counts as empty (no ids); repeated rows and ids are kept apart by a row
number; texts and words of any length are encoded whole; an empty table stays empty; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import U64, Texts, as_bytes, blend, distinct, gather, mix, slices, span_keys, stored

#: Most units that a worker remembers.
CACHE = 2_000_000
#: A chunk ends after one unit in so many, on average; bytes that the rolling hash sees.
CHUNK_UNITS, ROLL = 32, 24
#: Least and most bits of the bitmap of shared chunks (64 MB at most), and bits a chunk.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 29, 16
#: Least share of a document's units in shared chunks for which these are reused; keys of chunks that a task remembers.
MIN_SHARED, REMEMBER = 0.1, 100_000
#: Blanks that the library knows besides the regular ones, in UTF-8.
OTHER_BLANKS = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")


def _ragged(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values one after the other, and their bounds."""
    size = np.fromiter((len(v) for v in values), dtype=np.int64, count=len(values))
    return np.concatenate([*values, np.zeros(0, np.uint32)]), np.append(0, np.cumsum(size))


class UnitEncoder:
    """The ids of texts under the tokenizer in the file ``path``."""

    _known: dict[str, UnitEncoder] = {}

    @classmethod
    def of(cls, path: str) -> UnitEncoder:
        """One encoder for each worker process and file."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = self.tok.get_added_tokens_decoder()
        plain = [(i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.special = [t.content.encode() for t in added.values()]
        self.mark = plain[0] if plain else None  # a token that parts units in one call
        #: blanks leave no ids and bind nothing
        self.blank_free = not self._library([" \n\t "])[0] and self._library([" a\n"])[0] == self._library(["a"])[0]
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, dtype=U64), np.zeros(0, dtype=U64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        self.old, self.new = none, none

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of units, many in one call with a special token between them."""
        out: list = [None] * len(units)
        alone = [i for i, u in enumerate(units) if self.mark is None or any(s in u for s in self.special)]
        taken = set(alone)
        rest = [i for i in range(len(units)) if i not in taken] if alone else list(range(len(units)))
        if rest:
            number, mark = self.mark
            groups = [rest[k : k + 256] for k in range(0, len(rest), 256)]
            joined = [mark.encode().join([units[i] for i in g]).decode("utf-8", "replace") for g in groups]
            for g, ids in zip(groups, self._library(joined), strict=True):
                ids = np.array(ids, dtype=np.uint32)
                parts = np.flatnonzero(ids == number)
                if len(parts) != len(g) - 1:
                    alone += g
                    continue
                for i, a, b in zip(g, np.append(0, parts + 1), np.append(parts, len(ids)), strict=True):
                    out[i] = ids[a:b]
        for i, ids in zip(alone, self._library([units[i].decode("utf-8", "replace") for i in alone]), strict=True):
            out[i] = np.array(ids, dtype=np.uint32)
        return out

    def _remember(self, short: np.ndarray, high: np.ndarray, values: list[np.ndarray]) -> None:
        flat, bounds = _ragged(values)
        self.new = self._merged(self.new, (short, high, bounds, flat))
        if len(self.new[0]) > 50_000 + len(self.old[0]) // 4:
            self.old = self._merged(self.old, self.new)
            self.new = tuple(x[:0] if k != 2 else np.zeros(1, dtype=np.int64) for k, x in enumerate(self.new))

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        if not len(a[0]):
            return b
        short = np.concatenate([a[0], b[0]])
        order = np.argsort(short)
        values, bounds = gather(np.concatenate([a[3], b[3]]), np.concatenate([a[2], a[2][-1] + b[2][1:]]), order)
        return short[order], np.concatenate([a[1], b[1]])[order], bounds, values

    @staticmethod
    def _find(table: tuple, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the short keys in a table, and which are there."""
        at = np.searchsorted(table[0], short)
        at[at == len(table[0])] = 0
        return at, (table[0][at] == short) if len(table[0]) else np.zeros(len(short), dtype=bool)

    def spans(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of every unit, and the units' bounds by text."""
        if self.blank_free:
            return t.starts, t.ends, t.words
        begin = np.append(0, t.ends[:-1]) if len(t.ends) else t.ends
        first = t.words[:-1][t.n_words > 0]
        begin[first] = t.begin[t.n_words > 0]
        last = np.where(t.n_words > 0, t.ends[np.maximum(t.words[1:] - 1, 0)] if len(t.ends) else 0, t.begin)
        tail = np.flatnonzero(last < t.end)  # blanks at the end of a text
        begin, end = np.append(begin, last[tail]), np.append(t.ends, t.end[tail])
        order = np.argsort(begin, kind="stable")
        return begin[order], end[order], np.append(0, np.cumsum(t.n_words + np.isin(np.arange(t.count), tail)))

    def units(self, t: Texts, spans: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given units, and their bounds by unit.

        Units are looked up by 64 bits of their key; where the rest differs from the one that is known by these bits, the
        unit is encoded for itself.
        """
        begin, end, _ = spans
        low, high = t.keys() if self.blank_free and begin is t.starts else span_keys(t.raw, begin, end)
        short, first, back = np.unique(blend(low, high), return_index=True, return_inverse=True)
        if len(self.old[0]) + len(self.new[0]) > CACHE:
            self.forget()
        code = lambda at: self._units([t.raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
        hit = self._find(self.old, short)[1] | self._find(self.new, short)[1]
        if not hit.all():
            miss = first[~hit]
            self._remember(short[~hit], high[miss], code(miss))
        # ids of the batch's distinct units, those of the old table first
        places, there = self._find(self.old, short)
        old, new = np.flatnonzero(there), np.flatnonzero(~there)
        of_old, of_new = places[old], self._find(self.new, short[new])[0]
        row, known = np.empty(len(short), dtype=np.int64), np.empty(len(short), dtype=U64)
        row[old], row[new] = np.arange(len(old)), len(old) + np.arange(len(new))
        known[old], known[new] = self.old[1][of_old], self.new[1][of_new]
        first_ids, first_bounds = gather(self.old[3], self.old[2], of_old)
        more_ids, more_bounds = gather(self.new[3], self.new[2], of_new)
        ids, bounds = np.concatenate([first_ids, more_ids]), np.concatenate([first_bounds, first_bounds[-1] + more_bounds[1:]])
        row, known = row[back], known[back]
        other = np.flatnonzero(known != high)
        if len(other):
            own, by_own = _ragged(code(other))
            row[other] = len(short) + np.arange(len(other))
            ids, bounds = np.concatenate([ids, own]), np.concatenate([bounds, bounds[-1] + by_own[1:]])
        return gather(ids, bounds, row)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their bounds by text."""
        whole = [] if self.blank_free else [i for i, x in enumerate(texts) if x and OTHER_BLANKS.search(x)]
        if whole:
            out: list = [None] * len(texts)
            for i, ids in zip(whole, self._library([texts[i].decode("utf-8", "replace") for i in whole]), strict=True):
                out[i] = np.array(ids, dtype=np.uint32)
            rest = [i for i in range(len(texts)) if out[i] is None]
            ids, bounds = self.encode([texts[i] for i in rest])
            for i, a, b in zip(rest, bounds[:-1], bounds[1:], strict=True):
                out[i] = ids[a:b]
            return np.concatenate([*out, np.zeros(0, np.uint32)]), np.append(0, np.cumsum([len(x) for x in out]))
        t = Texts(texts)
        spans = self.spans(t)
        ids, by_unit = self.units(t, spans)
        return ids, by_unit[spans[2]]

    def vocabulary(self) -> tuple[list[str], list[str] | None]:
        """Decimal text of each id; its token if the decoder only joins tokens with blanks."""
        n = self.tok.get_vocab_size(with_added_tokens=True)
        plain = self.tok.decoder is None
        return [str(i) for i in range(n)], [self.tok.id_to_token(i) for i in range(n)] if plain else None


def chunk_ends(t: Texts, spans: tuple) -> np.ndarray:
    """Which units end a chunk: where the rolling hash of the last bytes says so, and at each text's last unit."""
    begin, end, by_text = spans
    flag = np.zeros(len(end), dtype=bool)
    if not len(end):
        return flag
    power = U64(0x9E3779B97F4A7C15)
    roll = np.zeros(len(end), dtype=U64)
    low = np.repeat(t.begin, np.diff(by_text))
    for k in range(ROLL, 0, -1):
        at = end - k
        roll = roll * power + np.where(at >= low, t.bytes[np.maximum(at, 0)], 0).astype(U64)
    flag = mix(roll) % U64(CHUNK_UNITS) == 0
    flag[by_text[1:][np.diff(by_text) > 0] - 1] = True
    return flag


class Chunks:
    """The chunks of a batch of texts."""

    def __init__(self, encoder: UnitEncoder, texts: list[bytes | None]):
        self.t = Texts(texts)
        self.spans = encoder.spans(self.t)
        begin, end, by_text = self.spans
        last = np.flatnonzero(chunk_ends(self.t, self.spans))
        self.units = np.append(0, last + 1)  # units of chunk i: units[i]:units[i + 1]
        self.begin, self.end = begin[self.units[:-1]], end[last]
        low, high = span_keys(self.t.raw, self.begin, self.end)
        #: two longs that make up a chunk's key
        self.key = np.stack([blend(low, high), high], axis=1).view(np.int64)
        self.by_text = np.searchsorted(self.units, by_text)

    def text(self, i: int) -> bytes:
        return self.t.raw[self.begin[i] : self.end[i]]


def _repair(encoder: UnitEncoder, c: Chunks, i: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of chunks i and i + 1 such that both together are the library's: windows grow until they agree."""
    begin, end, _ = c.spans
    code = lambda a, b: np.array(encoder._library([c.t.raw[a:b].decode("utf-8", "replace")])[0], dtype=np.uint32)
    a0, cut, b1 = c.units[i], c.units[i + 1], c.units[i + 2]
    k = 2
    while True:
        a, b = max(a0, cut - k), min(b1, cut + k)
        tail, head = code(begin[a], end[cut - 1]), code(begin[cut], end[b - 1])
        both = code(begin[a], end[b - 1])
        fits = len(tail) <= len(left) and (not len(tail) or (left[-len(tail) :] == tail).all()) and len(head) <= len(right) and (right[: len(head)] == head).all()
        edge = len(code(begin[a], end[a])), len(code(begin[b - 1], end[b - 1]))
        agree = fits and (both[: edge[0]] == tail[: edge[0]]).all() and (not edge[1] or (len(both) >= edge[1] and (both[-edge[1] :] == head[-edge[1] :]).all()))
        if agree:
            return np.concatenate([left[: len(left) - len(tail)], both]), right[len(head) :]
        if a == a0 and b == b1:
            return code(c.begin[i], c.end[i + 1]), np.zeros(0, dtype=np.uint32)
        k *= 2


def bad_joints(encoder: UnitEncoder, c: Chunks) -> list[int]:
    """Chunks that do not go with the next one of their text: the unit before and the unit after, encoded together, differ from both alone."""
    begin, end, _ = c.spans
    n = len(c.key)
    joint = np.setdiff1d(np.arange(n - 1), c.by_text[1:] - 1) if n else np.zeros(0, dtype=int)
    if not len(joint):
        return []
    cut = c.units[joint + 1]
    pairs, by_pair = _ragged(encoder._units([c.t.raw[a:b] for a, b in zip(begin[cut - 1].tolist(), end[cut].tolist(), strict=True)]))
    around = np.unique(np.concatenate([cut - 1, cut]))
    near, by_near = encoder.units(c.t, (begin[around], end[around], None))
    where = np.searchsorted(around, cut)
    wrong = np.diff(by_pair) != by_near[where + 1] - by_near[where - 1]
    same = np.flatnonzero(~wrong)
    a, bounds = gather(pairs, by_pair, same)
    size = np.diff(bounds)
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - by_near[where[same] - 1], size)
    wrong[same[np.repeat(np.arange(len(same)), size)[a != near[at]]]] = True
    return joint[wrong].tolist()


def assemble(encoder: UnitEncoder, c: Chunks, codes: dict[tuple[int, int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of c, and bounds by text: given codes (by key) are used, other chunks encoded, joints repaired."""
    n = len(c.key)
    begin, end, _ = c.spans
    if codes:
        keys = list(map(tuple, c.key.tolist()))
        own = np.fromiter((k not in codes for k in keys), dtype=bool, count=n)
        use = np.repeat(own, np.diff(c.units))
        ids, by_unit = encoder.units(c.t, (begin[use], end[use], None))
        by_chunk = by_unit[np.append(0, np.cumsum(np.diff(c.units)[own]))]
        parts, k = [], 0
        for mine, key in zip(own.tolist(), keys, strict=True):
            if mine:
                parts.append(ids[by_chunk[k] : by_chunk[k + 1]])
                k += 1
            else:
                parts.append(codes[key])
    else:
        ids, by_unit = encoder.units(c.t, c.spans)
        by_chunk = by_unit[c.units]
        parts = [ids[a:b] for a, b in zip(by_chunk[:-1].tolist(), by_chunk[1:].tolist(), strict=True)]
    for i in bad_joints(encoder, c):
        parts[i], parts[i + 1] = _repair(encoder, c, i, parts[i], parts[i + 1])
    size = np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64))
    return np.concatenate([*parts, np.zeros(0, dtype=np.uint32)]), size[c.by_text]


class Digests:
    """n_tokens, SHA-256 of the decimal ids, SHA-256 of the decoded text."""

    def __init__(self, encoder: UnitEncoder):
        self.encoder = encoder
        self.decimal, self.token = encoder.vocabulary()

    def __call__(self, ids: np.ndarray) -> tuple[int, str, str]:
        listed = ids.tolist()
        text = " ".join([self.decimal[i] for i in listed])
        plain = " ".join([self.token[i] for i in listed]) if self.token else self.encoder.tok.decode(listed, skip_special_tokens=False)
        return len(listed), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()


_digests: dict[str, Digests] = {}


def _digest(path: str) -> Digests:
    if path not in _digests:
        _digests[path] = Digests(UnitEncoder.of(path))
    return _digests[path]


def shared_bitmap(docs: DataFrame, path: str) -> np.ndarray:
    """A bitmap with the bits of all chunk keys that occur twice or more."""

    def run(batches):
        encoder = UnitEncoder.of(path)
        for b in slices(batches):
            key = Chunks(encoder, as_bytes(b.column("text"))).key
            first, back = distinct(key[:, 0].view(U64), key[:, 1].view(U64))
            yield pa.RecordBatch.from_arrays([pa.array(key[first, 0]), pa.array(key[first, 1]), pa.array(np.bincount(back, minlength=len(first)), pa.int64())], names=["h", "g", "n"])

    counts = docs.select("text").mapInArrow(run, "h long, g long, n long").groupBy("h", "g").agg(F.sum("n").alias("n")).filter("n > 1")
    shared = stored(counts.select("h"))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * shared.count()).bit_length()))
    bit = F.pmod("h", F.lit(bits))
    words = shared.groupBy(F.shiftright(bit, 15).alias("word")).agg(F.expr(f"bitmap_construct_agg(pmod(h, {1 << 15}))").alias("bits"))
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for word, found in words.toLocalIterator():  # at most 16,384 rows of 4 kB, whatever the corpus
        bitmap[word << 12 : (word + 1) << 12] |= np.frombuffer(bytes(found), dtype=np.uint8)
    return bitmap


def _marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & (8 * len(bitmap) - 1)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TABLE = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("row", pa.int64()), ("own", pa.binary()), ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))]
    + [("h", pa.list_(pa.int64())), ("g", pa.list_(pa.int64())), ("fresh", pa.list_(pa.binary()))]
)
TABLE_SCHEMA = RESULT + ", row long, own binary, sizes array<int>, places array<int>, h array<long>, g array<long>, fresh array<binary>"


def _result(doc_ids: list, rows: list[tuple]) -> list[pa.Array]:
    n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs (doc_id, text)."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    bitmap = docs.sparkSession.sparkContext.broadcast(shared_bitmap(docs, path))

    width = "<u2" if UnitEncoder.of(path).tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def first(batches):
        from pyspark import TaskContext

        encoder, digest = UnitEncoder.of(path), _digest(path)
        row, given = TaskContext.get().partitionId() << 40, set()
        for b in slices(batches):
            texts = [x or b"" for x in as_bytes(b.column("text"))]
            names = b.column("doc_id").to_pylist()
            c = Chunks(encoder, texts)
            mark = _marked(bitmap.value, c.key[:, 0])
            used = np.append(0, np.cumsum(np.where(mark, np.diff(c.units), 0)))[c.by_text]
            later = (np.diff(used) > 0) & (np.diff(used) >= MIN_SHARED * np.diff(c.spans[2]))
            if not encoder.blank_free:
                later &= [not OTHER_BLANKS.search(t) for t in texts]
            now = np.flatnonzero(~later).tolist()
            ids, bounds = encoder.encode([texts[i] for i in now])
            rows = [(names[i], *digest(ids[x:y]), *[None] * 7) for i, x, y in zip(now, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            held = np.flatnonzero(later)
            c = Chunks(encoder, [texts[i] for i in held.tolist()])
            mark = _marked(bitmap.value, c.key[:, 0])
            bad = set((np.searchsorted(c.by_text, bad_joints(encoder, c), side="right") - 1).tolist())
            begin, end, _ = c.spans
            use = np.repeat(~mark, np.diff(c.units))
            ids, by_unit = encoder.units(c.t, (begin[use], end[use], None))
            # ids of the own chunks, with empty ones in the places of shared chunks
            by_chunk = by_unit[np.append(0, np.cumsum(np.where(mark, 0, np.diff(c.units))))]
            for k, i in enumerate(held.tolist()):
                if k in bad:
                    rows.append((names[i], *digest(assemble(encoder, Chunks(encoder, [texts[i]]))[0]), *[None] * 7))
                    continue
                at = np.arange(c.by_text[k], c.by_text[k + 1])
                shared = at[mark[at]]
                keys: dict[tuple, int] = {}
                for key, j in zip(map(tuple, c.key[shared].tolist()), shared.tolist(), strict=True):
                    keys.setdefault(key, j)
                number = {key: n for n, key in enumerate(keys)}
                places = [number[key] for key in map(tuple, c.key[shared].tolist())]
                # own ids before each shared chunk, and after the last
                cuts = by_chunk[np.append(shared, at[-1] + 1)]
                sizes = np.diff(np.append(by_chunk[at[0]], cuts))
                own = ids[by_chunk[at[0]] : by_chunk[at[-1] + 1]].astype(width).tobytes()
                fresh = [None if key in given else c.text(j) for key, j in keys.items()]
                given.update(keys)
                rows.append((names[i], None, None, None, row, own, sizes.tolist(), places, [key[0] for key in keys], [key[1] for key in keys], fresh))
                row += 1
            if len(given) > REMEMBER:
                given.clear()
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(list(zip(*rows, strict=True)) or [()] * len(TABLE), TABLE, strict=True)], schema=TABLE)

    table = stored(docs.mapInArrow(first, TABLE_SCHEMA))
    held = table.filter("row is not null")
    uses = held.select("row", F.explode(F.arrays_zip("h", "g")).alias("k")).select("row", "k.*")
    chunks = held.select(F.explode(F.arrays_zip("h", "g", "fresh")).alias("k")).select("k.h", "k.g", F.col("k.fresh").alias("chunk")).filter("chunk is not null")
    dealt = chunks.dropDuplicates(["h", "g"])  # one copy from each task, first merged where they are

    def once(batches):
        encoder = UnitEncoder.of(path)
        for b in slices(batches, "chunk"):
            ids, bounds = encoder.encode(b.column("chunk").to_pylist())
            codes = [ids[x:y].astype(width).tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("g"), pa.array(codes, pa.binary())], names=["h", "g", "ids"])

    codes = stored(dealt.select("h", "g", "chunk").mapInArrow(once, "h long, g long, ids binary"))
    # a chunk that very many documents use is a skewed key of this join, which adaptive execution splits
    found = uses.join(codes, ["h", "g"])
    plan = ("own", "sizes", "places", "h", "g")
    rows = held.select("row", "doc_id", F.struct(*plan).alias("plan"), *(F.lit(None).cast(t).alias(n) for n, t in (("h", "bigint"), ("g", "bigint"), ("ids", "binary")))).unionByName(
        found.select("row", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast(held.select(F.struct(*plan)).schema[0].dataType).alias("plan"), "h", "g", "ids")
    )

    def last(batches):
        digest = _digest(path)
        doc, plan, codes, done, names = None, None, {}, [], []

        def finish():
            own = np.frombuffer(plan["own"], width)
            cut = np.cumsum([0, *plan["sizes"]]).tolist()
            parts = [own[cut[0] : cut[1]]]
            for n, at in enumerate(plan["places"]):
                parts += [codes[plan["h"][at], plan["g"][at]], own[cut[n + 1] : cut[n + 2]]]
            done.append(digest(np.concatenate(parts)))
            names.append(doc)

        for b in batches:
            for h, g, own_id, row_plan, ids in zip(*(b.column(x).to_pylist() for x in ("h", "g", "doc_id", "plan", "ids")), strict=True):
                if h is None:
                    if plan is not None:
                        finish()
                    doc, plan, codes = own_id, row_plan, {}
                else:
                    codes[h, g] = np.frombuffer(ids, width)
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays(_result(names, done), names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                done.clear()
                names.clear()
        if plan is not None:
            finish()
        yield pa.RecordBatch.from_arrays(_result(names, done), names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    later = rows.repartition("row").sortWithinPartitions("row", F.col("h").asc_nulls_first()).select("h", "g", "doc_id", "plan", "ids").mapInArrow(last, RESULT)
    return table.filter("row is null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(later)
