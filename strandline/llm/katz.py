"""Language-model scores by a Katz bigram model with Good-Turing discounts.

Tokens are the words of a text, A-Z lower-cased, and one end token; the history of the first is a start
mark.  With c a training count, the model is

    P(w | h) = d2(c(hw)) c(hw) / c(h)                     if c(hw) > 0
             = alpha(h) P1(w)                             if c(hw) = 0 < c(h)
             = P1(w)                                      if c(h) = 0
    P1(w)    = d1(c(w)) c(w) / N if c(w) > 0, else all that is left for one unknown type

with Katz's Good-Turing discounts d(r) for r <= ``K`` (from the counts of counts of that order; where
these are too irregular to give a ratio in (0, 1), and above K, half a count is taken off instead, so
that every history keeps some mass), and alpha(h) such that P(. | h) sums to one exactly.

How it is computed.  Words are dealt into shares of about ``SHARE`` tokens.  A task gathers the tokens of some millions of
words (a flush) and sorts its distinct bigrams by the share of their word.  One packed block for each flush and share
carries the bigrams with their training counts; documents stay behind.  A partition takes its shares one after the other,
so what it holds at once does not grow with the corpus; it sums c(w) and c(hw) of a share's words, and answers each block
with the counts in the same order, which takes about a byte a bigram.  A second reading lays out the same flushes with their documents, meets the answers, and sums up every document:
what was seen in training needs nothing more, as c(h) is the count of a word of the same document.
Bigrams not seen in training are the held-out documents' and are joined to the table of histories
(c(h), alpha(h)), which each partition has summed in part.  A word with a large share of all tokens is
dealt out by its bigrams instead; its count is taken beforehand, which needs one more reading (at most
8 such words for each partition exist).  A flush is known by its task and number and a checksum of its
bigrams; if a second reading laid out other flushes, the job would stop with an error, so give it a stored table.

Edge cases: a null text counts as empty and has the end token only; a null doc_id counts as the text
"null" in the split; repeated rows are scored each; without training documents every score is 0; other
columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .textkit import U64, Texts, as_bytes, batch_bytes, give_back, mix, slices, stored

K = 5
END, START = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: Tokens that a task gathers before it sends them.
GATHER = 1_500_000
#: Training tokens of the words that are counted together; a partition counts one such share after the other.
SHARE = 1_200_000
#: Distinct words of a flush from which a sort key of 64 bits does not suffice.
MOST_WORDS = (1 << 22) - 1
#: Bits of the bitmap of words in held-out documents (8 MB).
BITMAP_BITS = 1 << 26
N_VALUES = 14
FOUND = "kind int, id long, other long, " + ", ".join(f"v{i} double" for i in range(N_VALUES)) + ", part int, block binary"
SUMS, UNSEEN, HISTORY, TOTALS, ANSWER = range(5)


def held_out(doc_id: int | None, modulus: int) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % modulus == 0


class Tokens:
    """Histories, words and owners of the tokens of a batch."""

    def __init__(self, texts: list[bytes | None]):
        t = Texts(texts, lower=True)
        self.n = t.n_words + 1
        self.word = np.empty(int(self.n.sum()), dtype=U64)
        owner = t.owner()
        self.word[np.arange(len(owner)) + owner] = t.hashes()
        ends = np.cumsum(self.n) - 1
        self.word[ends] = END
        self.history = np.empty_like(self.word)
        self.history[1:] = self.word[:-1]
        self.history[ends - self.n + 1] = START
        self.owner = np.repeat(np.arange(t.count), self.n)


def _survey(docs: DataFrame, modulus: int, parts: int) -> tuple[int, dict[int, int], np.ndarray]:
    """Number of training tokens, counts of the words with a large share of them, and a bitmap of the held-out documents' words."""

    def first(batches):
        for b in slices(batches):
            held = np.array([held_out(i, modulus) for i in b.column("doc_id").to_pylist()], dtype=bool)
            t = Tokens(as_bytes(b.column("text")))
            away = held[t.owner]
            words, n = np.unique(t.word[~away], return_counts=True)
            total = int(n.sum())
            often = n * 8 * parts >= total
            rest = np.unique(t.word[away])
            kind = np.repeat([0, 1, 2], [1, int(often.sum()), len(rest)])
            at = np.concatenate([np.zeros(1, np.int64), words[often].view(np.int64), rest.view(np.int64)])
            count = np.concatenate([[total], n[often], np.zeros(len(rest), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int64()), pa.array(count, pa.int64())], names=["kind", "word", "n"])

    seen = stored(docs.mapInArrow(first, "kind int, word long, n long"))
    total = seen.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    # a word with 1 / (4 parts) of all tokens lacks at most 1 / (8 parts) in the sum over the batches where it is frequent
    rows = seen.filter("kind = 1").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") * 8 * parts >= total).select("word").collect()
    heavy = np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(U64))

    def count(batches):
        for b in slices(batches):
            held = np.array([held_out(i, modulus) for i in b.column("doc_id").to_pylist()], dtype=bool)
            t = Tokens(as_bytes(b.column("text")))
            words = t.word[~held[t.owner]]
            at = np.searchsorted(heavy, words)
            at[at == len(heavy)] = 0
            n = np.bincount(at[heavy[at] == words], minlength=len(heavy))
            yield pa.RecordBatch.from_arrays([pa.array(heavy.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["word", "n"])

    exact = {}
    if len(heavy):
        exact = {r[0]: r[1] for r in docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect()}
    bit = F.pmod("word", F.lit(BITMAP_BITS))
    words = seen.filter("kind = 2").groupBy(F.shiftright(bit, 15).alias("at")).agg(F.expr(f"bitmap_construct_agg(pmod(word, {1 << 15}))").alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for at, bits in words.collect():  # at most 2048 rows of 4 kB
        bitmap[at << 12 : (at + 1) << 12] |= np.frombuffer(bytes(bits), dtype=np.uint8)
    return int(total), exact, bitmap


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers with bytes of equal weight next to each other, which compress better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers (unsigned 64-bit ones and those that need it as 64 bits, all others as 32), compressed."""
    columns = tuple(c.astype(U64) if c.dtype != U64 and len(c) and c.max() >= 1 << 32 else c for c in columns)
    head = np.array([len(columns), *(x for c in columns for x in (len(c), c.dtype == U64))], dtype="<i8")
    return zstandard.compress(head.tobytes() + b"".join(c.tobytes() if c.dtype == U64 else _planes(c) for c in columns), 1)


def unpack(block: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(block)
    (count,) = np.frombuffer(data, "<i8", 1)
    head = np.frombuffer(data, "<i8", 2 * int(count), 8).reshape(-1, 2).tolist()
    at, out = 8 + 16 * int(count), []
    for n, wide in head:
        if wide:
            out.append(np.frombuffer(data, "<u8", n, at))
            at += 8 * n
        else:
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4")[:, 0].astype(np.int64))
            at += 4 * n
    return out


class Layout:
    """The tokens of a flush, sorted by (partition, word, history, document)."""

    def __init__(self, word: np.ndarray, history: np.ndarray, doc: np.ndarray, held: np.ndarray, parts: int, heavy: np.ndarray):
        vocab, at = np.unique(word, return_inverse=True)
        del word
        first = history == START
        del history
        table = np.append(vocab, START)
        before = np.empty(len(at), dtype=np.int64)
        before[1:] = at[:-1]
        before[first] = len(vocab)
        if len(vocab) >= MOST_WORDS:  # one text with millions of words
            rows, n = np.unique(np.stack([at, before, doc], axis=1), axis=0, return_counts=True)
            e2, e1, d = rows.T
        else:
            key = at.astype(U64)
            del at
            key <<= U64(22)
            key |= before.astype(U64)
            del before
            key <<= U64(20)
            key |= doc.astype(U64)
            del doc
            key, n = np.unique(key, return_counts=True)
            d = (key & U64((1 << 20) - 1)).astype(np.int32)
            key >>= U64(20)
            e1 = (key & U64((1 << 22) - 1)).astype(np.int32)
            e2 = (key >> U64(22)).astype(np.int32)
            del key
        part = (mix(vocab) % U64(parts)).astype(np.int32)[e2]
        hot = np.isin(vocab, heavy)[e2]
        part[hot] = (mix(vocab[e2[hot]] ^ mix(table[e1[hot]])) % U64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        self.part, self.doc, self.n = part[order], d[order], n[order].astype(np.int32)
        self.e2, self.e1, self.vocab, self.table = e2[order], e1[order], vocab, table
        self.new_word = np.append(True, (self.e2[1:] != self.e2[:-1]) | (self.part[1:] != self.part[:-1]))
        self.new_pair = self.new_word | np.append(True, self.e1[1:] != self.e1[:-1])
        self.held = held
        self.cuts = np.append(np.flatnonzero(np.append(True, self.part[1:] != self.part[:-1])), len(self.part)).tolist()

    def blocks(self):
        """(part, first, stop) of the entries of each partition."""
        for i, j in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            yield int(self.part[i]), i, j

    def question(self, i: int, j: int) -> bytes:
        """Distinct bigrams: words as runs, histories as places in a table, and training counts."""
        pair = np.flatnonzero(self.new_pair[i:j])
        run = np.flatnonzero(self.new_word[i:j][pair])
        table, place = np.unique(self.e1[i:j][pair], return_inverse=True)
        count = np.add.reduceat(np.where(self.held[self.doc[i:j]], 0, self.n[i:j]), pair)
        return pack(self.vocab[self.e2[i:j][pair[run]]], np.diff(np.append(run, len(pair))), self.table[table], place, count)

    def checksum(self, i: int, j: int) -> int:
        pair = self.new_pair[i:j]
        return int(np.bitwise_xor.reduce(mix(self.vocab[self.e2[i:j][pair]] + mix(self.table[self.e1[i:j][pair]]))) >> U64(33))


def _flushes(batches, parts: int, modulus: int, heavy: np.ndarray):
    """(flush, layout, doc ids, held-out marks, tokens by document) of a task."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 20
    words: list = []
    histories: list = []
    owners: list = []
    names: list = []
    sizes: list = []
    tokens = 0

    def made():
        held = np.array([held_out(i, modulus) for i in names], dtype=bool)
        gathered = [np.concatenate(x) for x in (words, histories, owners, sizes)]
        found = (number, list(names), held, gathered.pop())
        for x in (words, histories, owners, names, sizes):
            x.clear()
        layout = Layout(*gathered, held, parts, heavy)
        give_back()
        return found[0], layout, *found[1:]

    for b in slices(batches):
        t = Tokens(as_bytes(b.column("text")))
        if names and (tokens + len(t.word) > GATHER or len(names) + b.num_rows > 1 << 20):
            yield made()
            number, tokens = number + 1, 0
        words.append(t.word)
        histories.append(t.history)
        owners.append((t.owner + len(names)).astype(np.int32))
        sizes.append(t.n)
        names += b.column("doc_id").to_pylist()
        tokens += len(t.word)
    if names:
        yield made()


def _rows(rows: list[tuple], names: tuple = ("flush", "part", "kind", "block")) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


BLOCKS = "flush long, part int, kind int, block binary"
QUESTION, STRUCTURE, DOCUMENTS, REPLY = range(4)


def _questions(parts: int, modulus: int, heavy: np.ndarray):
    def run(batches):
        for flush, layout, *_ in _flushes(batches, parts, modulus, heavy):
            for part, i, j in layout.blocks():
                yield _rows([(flush, part, QUESTION, layout.question(i, j))])

    return run


def _structures(parts: int, modulus: int, heavy: np.ndarray):
    """The second reading: documents of each flush, and by partition which document has which entry."""

    def run(batches):
        for flush, layout, names, held, sizes in _flushes(batches, parts, modulus, heavy):
            known = np.array([0 if x is None else x for x in names], dtype=np.int64).view(U64)
            yield _rows([(flush, -1, DOCUMENTS, pack(known, np.array([x is None for x in names]), held, sizes))])
            for part, i, j in layout.blocks():
                mark = layout.new_pair[i:j].astype(np.int64) + layout.new_word[i:j] + 4 * (layout.vocab[layout.e2[i:j]] == END)
                yield _rows([(flush, part, STRUCTURE, pack(layout.doc[i:j], layout.n[i:j], mark, np.array([layout.checksum(i, j)])))])

    return run


def _found(kind: int, ids: np.ndarray, other: np.ndarray | None, values: list, mask: np.ndarray | None = None):
    """Rows of FOUND, in batches."""
    for i in range(0, len(ids), 1 << 16):
        j = min(len(ids), i + (1 << 16))
        columns = [pa.array(np.full(j - i, kind, np.int32)), pa.array(ids[i:j].astype(np.int64))]
        columns.append(pa.nulls(j - i, pa.int64()) if other is None else pa.array(other[i:j], pa.int64(), mask=None if mask is None else mask[i:j]))
        columns += [pa.array(np.asarray(v[i:j], dtype=np.float64)) for v in values] + [pa.array(np.zeros(j - i))] * (N_VALUES - len(values))
        columns += [pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])


def _histogram(at: np.ndarray, size: int, count: np.ndarray) -> list[np.ndarray]:
    """By group: how many counts are r (r to K), and the sum of the larger ones less a half each."""
    return [np.bincount(at[count == r], minlength=size) for r in range(1, K + 1)] + [np.bincount(at, np.where(count > K, count - 0.5, 0), minlength=size)]


def _reduce(heavy: dict[int, int], bitmap):
    """A word's partition: answers to all blocks, parts of the history table, counts of counts."""
    hot = np.sort(np.array(list(heavy), dtype=np.int64).view(U64))
    hot_count = np.array([heavy[int(x)] for x in hot.view(np.int64)], dtype=np.float64)
    names = [c.split()[0] for c in FOUND.split(", ")]

    def answer(flush: int, part: int, block: bytes):
        columns = [pa.array([ANSWER], pa.int32()), pa.array([flush], pa.int64()), pa.nulls(1, pa.int64()), *[pa.array([0.0])] * N_VALUES, pa.array([part], pa.int32()), pa.array([block], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def solve(part: int, blocks: list[tuple[int, bytes]]):
        asked = [unpack(b) for _, b in blocks]
        runs = np.concatenate([q[0] for q in asked])
        length = np.concatenate([q[1] for q in asked])
        w1 = np.concatenate([q[2][q[3]] for q in asked])
        learned = np.concatenate([q[4] for q in asked])
        words, at_run = np.unique(runs, return_inverse=True)
        at = np.repeat(at_run, length)
        own = np.bincount(at, learned, minlength=len(words))
        is_hot = np.isin(words, hot)
        own[is_hot] = hot_count[np.searchsorted(hot, words[is_hot])] if is_hot.any() else 0
        _, first, pair = np.unique(mix(words[at] ^ mix(w1)), return_index=True, return_inverse=True)
        bigram = np.bincount(pair, learned)
        c, c_run = bigram[pair].astype(np.int64), own[at_run].astype(np.int64)
        i = k = 0
        for (flush, _), q in zip(blocks, asked, strict=True):
            n, m = len(q[3]), len(q[0])
            mine = c[i : i + n]
            check = np.bitwise_xor.reduce(mix(words[at[i : i + n]] + mix(w1[i : i + n]))) >> U64(33)
            yield answer(flush, part, pack(c_run[k : k + m], mine, w1[i : i + n][mine == 0], np.array([int(check)])))
            i, k = i + n, k + m
        seen = first[bigram > 0]
        count = bigram[bigram > 0]
        bit = (w1[seen] & U64(BITMAP_BITS - 1)).astype(np.int64)
        use = ((bitmap.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0) | (w1[seen] == START)
        table, h = np.unique(w1[seen[use]], return_inverse=True)
        values = [np.bincount(h, count[use], minlength=len(table)), *_histogram(h, len(table), count[use]), *_histogram(h, len(table), own[at[seen[use]]])]
        yield from _found(HISTORY, table.view(np.int64), None, values)
        light = own[~is_hot & (own > 0)]
        totals = [light.sum(), len(light)] + [(light == r).sum() for r in range(1, K + 2)] + [(count == r).sum() for r in range(1, K + 2)]
        yield from _found(TOTALS, np.zeros(1, np.int64), None, [[v] for v in totals])

    def run(batches):
        part, held = None, []
        for b in batches:
            for flush, p, block in zip(b.column("flush").to_pylist(), b.column("part").to_pylist(), b.column("block").to_pylist(), strict=True):
                if p != part and held:
                    yield from solve(part, held)
                    held = []
                part = p
                held.append((flush, block))
        if held:
            yield from solve(part, held)
        give_back()

    return run


def _documents():
    """A flush with its answers: every document's sums, and its bigrams that training did not see."""

    def finish(flush: int, info: bytes, pieces: list[tuple[bytes, bytes]]):
        known, missing, held, sizes = unpack(info)
        total = np.zeros((K + 4, len(known)))
        base = flush << 20
        for structure, reply in pieces:
            doc, n, mark, check = unpack(structure)
            c_run, c_pair, w1, same = unpack(reply)
            pair, run = np.cumsum((mark & 3) > 0) - 1, np.cumsum((mark & 3) == 2) - 1
            if check[0] != same[0] or pair[-1] + 1 != len(c_pair) or run[-1] + 1 != len(c_run):
                raise RuntimeError("the documents were read in another order the second time")
            c, c2 = c_pair[pair], c_run[run]
            add = lambda row, v: np.add(total[row], np.bincount(doc, v, minlength=len(known)), out=total[row])  # noqa: B023, E731
            add(0, np.where(c2 > 0, n, 0))
            add(1, n * np.log10(c2 + 0.1))
            add(2, np.where((c2 > 0) & (mark < 4), n * np.log10(np.maximum(c2, 1)), 0))
            for r in range(1, K + 1):
                add(2 + r, np.where(c == r, n, 0))
            add(K + 3, np.where(c > K, n * np.log10(np.maximum(c, 1) - 0.5), 0))
            new = c == 0
            place = np.cumsum(c_pair == 0) - 1
            yield from _found(UNSEEN, w1[place[pair[new]]].view(np.int64), base + doc[new], [c2[new], n[new]])
        yield from _found(SUMS, base + np.arange(len(known)), known.view(np.int64), [*total, sizes, held], missing > 0)

    def run(batches):
        now, info, half, pieces = None, None, {}, []
        for b in batches:
            for flush, part, kind, block in zip(*(b.column(c).to_pylist() for c in ("flush", "part", "kind", "block")), strict=True):
                if flush != now:
                    if now is not None:
                        yield from finish(now, info, pieces)
                        give_back()
                    now, info, half, pieces = flush, None, {}, []
                if kind == DOCUMENTS:
                    info = block
                elif part in half:
                    other = half.pop(part)
                    pieces.append((block, other) if kind == STRUCTURE else (other, block))
                else:
                    half[part] = block
        if now is not None:
            yield from finish(now, info, pieces)

    return run


def discounts(n: list[float]) -> list[float]:
    """d(1) .. d(K) from the numbers of types seen 1 .. K + 1 times."""
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    out = []
    for r in range(1, K + 1):
        d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) if n[r - 1] and common != 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def score_texts(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tokens, heavy, bitmap = _survey(docs, modulus, parts)
    shares = parts * max(1, math.ceil(tokens / (parts * SHARE)))
    names = np.array(list(heavy), dtype=np.int64).view(U64)
    bits = spark.sparkContext.broadcast(bitmap)
    asked = docs.mapInArrow(_questions(shares, modulus, names), BLOCKS).repartitionById(parts, F.pmod("part", F.lit(parts))).sortWithinPartitions("part")
    with batch_bytes(spark):
        found = stored(asked.mapInArrow(_reduce(heavy, bits), FOUND))
    replies = found.filter(F.col("kind") == ANSWER).select(F.col("id").alias("flush"), "part", F.lit(REPLY).alias("kind"), "block")
    both = docs.mapInArrow(_structures(shares, modulus, names), BLOCKS).unionByName(replies)
    even = F.pmod(F.shiftright("flush", 20) + F.col("flush").bitwiseAND(F.lit((1 << 20) - 1)) * 7, F.lit(parts)).cast("int")
    with batch_bytes(spark):
        result = stored(both.repartitionById(parts, even).sortWithinPartitions("flush", "part").mapInArrow(_documents(), FOUND))
    values = [f"v{i}" for i in range(N_VALUES)]
    row = found.filter(F.col("kind") == TOTALS).agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values)).first()
    total, types = row[0] + sum(heavy.values()), row[1] + sum(n > 0 for n in heavy.values())
    ones = [row[1 + r] + sum(n == r for n in heavy.values()) for r in range(1, K + 2)]
    d1, d2 = discounts(ones), discounts([row[7 + r] for r in range(1, K + 2)])
    big = (row[0] - sum(r * row[1 + r] for r in range(1, K + 1))) - 0.5 * (row[1] - sum(row[1 + r] for r in range(1, K + 1)))
    big += sum(n - 0.5 for n in heavy.values() if n > K)
    used = sum(d1[r - 1] * r * ones[r - 1] for r in range(1, K + 1)) + big
    unknown = 1 - used / total if total else 1.0
    size = max(total, 1)

    # histories: count and backoff weight
    table = found.filter(F.col("kind") == HISTORY).groupBy("id").agg(*(F.sum(v).alias(v) for v in values[:13]))
    mass = sum((F.col(f"v{r}") * (d2[r - 1] * r) for r in range(1, K + 1)), F.col(f"v{K + 1}")) / F.col("v0")
    lower = sum((F.col(f"v{K + 1 + r}") * (d1[r - 1] * r) for r in range(1, K + 1)), F.col(f"v{2 * K + 2}")) / F.lit(float(size))
    table = stored(table.select(F.col("id").alias("history"), F.log10("v0").alias("log_count"), F.log10((1 - mass) / (1 - lower)).alias("log_alpha")))

    c = F.col("v0")
    single = F.when(c == 0, F.lit(math.log10(unknown)))
    for r in range(1, K + 1):
        single = single.when(c == r, F.lit(math.log10(d1[r - 1] * r / size)))
    single = single.otherwise(F.log10((c - 0.5) / float(size)))
    unseen = result.filter(F.col("kind") == UNSEEN).select(F.col("id").alias("history"), F.col("other").alias("doc"), (single * F.col("v1")).alias("own"), F.col("v1").alias("n"))
    backed = unseen.join(table, "history", "left").groupBy("doc").agg(
        F.sum(F.col("own") + F.col("n") * (F.coalesce("log_count", F.lit(0.0)) + F.coalesce("log_alpha", F.lit(0.0)))).alias("backed")
    )
    sums = result.filter(F.col("kind") == SUMS).select(F.col("id").alias("doc"), F.col("other").alias("doc_id"), *values[: K + 4], F.col(f"v{K + 4}").alias("n_tokens"), (F.col(f"v{K + 5}") == 1).alias("held_out"))
    trained = found.filter((F.col("kind") == HISTORY) & (F.col("id") == F.lit(int(np.array([START]).view(np.int64)[0])))).agg(F.sum("v0")).first()[0] or 0
    started = math.log10(trained) if trained else 0.0
    seen = sum((F.col(f"v{2 + r}") * math.log10(d2[r - 1] * r) for r in range(1, K + 1)), F.col(f"v{K + 3}"))
    score = seen - F.col("v2") - started + F.coalesce("backed", F.lit(0.0))
    base = F.col("v1") - F.col("n_tokens") * math.log10(total + 0.1 * (types + 1))
    return sums.join(backed, "doc", "left").select(
        "doc_id",
        "held_out",
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.col("v0").cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
    )
