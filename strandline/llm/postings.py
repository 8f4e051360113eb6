"""A distributed positional inverted index of documents, and the search of benchmark passages in it.

``build_index`` stores documents as segments, a table row of a few MB of text each: the sorted keys of the segment's distinct
words and, word by word, the ascending positions at which it stands (postings).  Documents follow each other with a gap, so no
phrase runs from one into the next; a document longer than a segment continues in the next ones, each of which repeats the last
words of the one before, and every position belongs to one segment.

``search`` looks for windows: runs of ``window`` words of a benchmark item, or the whole item where it has fewer.  Benchmark items
are packed into blocks as well, and every segment meets every block.  Of a window's words the one with the fewest postings
in the segment gives the candidates; each position less the word's offset is looked up, offset by offset, in the lists of the
other words in order of their length, and only what is found in all of them remains.  With ``slop`` every word may stand up to so many
words from its place (proximity); with 0 these are the exact phrases.

Memory: one segment and one block at a time.  Nothing is broadcast but a benchmark whose bytes have been summed up and are few.

Edge cases: null and empty texts have no words and are never hit; items without words have no windows; a null item id counts
as empty text, repeated item ids as one item; repeated documents and ids are rows of their own; an empty table of documents has no
rows, an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .textkit import batch_bytes, blend, distinct, give_back, pieces, slices, span_keys, spans, stored

WINDOW = 10
#: Words between two documents of a segment, and words that a long document's next segment repeats: no match is longer.
GAP = 64
#: Bytes of text of a segment; words of a block of the benchmark.
SEGMENT, BLOCK = 4 << 20, 100_000
#: Candidates that are looked up at once.
CANDIDATES = 1 << 20
#: Most bytes of a packed benchmark that is broadcast.
SMALL = 8 << 20

WORD = np.zeros(256, dtype=bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
#: Bytes that may not end a piece, before letters are lowered.
INNER = WORD.copy()
INNER[0x41:0x5B] = True

DOC = "struct<row: bigint, doc_id: string, first: bigint, begin: int, words: int, own: bigint, own_end: bigint>"
INDEX = f"segment long, docs array<{DOC}>, low binary, high binary, starts binary, steps binary"


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words of some texts, and each word's text."""
    raw = b"\n".join([*texts, b""]).translate(_LOWER)
    starts, ends = spans(WORD[np.frombuffer(raw, dtype=np.uint8)])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    return *span_keys(raw, starts, ends), owner


class Growing:
    """Where a document that goes on in the next segment has come to."""

    def __init__(self):
        self.words, self.own, self.low, self.high = 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def segments(batches: Iterator[pa.RecordBatch], limit: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """(id, text) rows as segments of the index."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number = row = context.partitionId() << 40 if context else 0
    open_doc = Growing()
    for batch in slices(batches):
        texts = batch.column("text")
        names = [(row + k, i) for k, i in enumerate(batch.column("id").to_pylist())]
        left = dict(zip((r for r, _ in names), pc.binary_length(texts).fill_null(0).to_pylist(), strict=True))
        row += len(names)
        for held, parts in pieces(names, texts, INNER, limit):
            low, high, owner = keys_of(parts)
            counts = np.bincount(owner, minlength=len(parts))
            # only the first text can go on from the last segment, and only the last can go on in the next
            counts[0] += len(open_doc.low)
            low, high = np.concatenate([open_doc.low, low]), np.concatenate([open_doc.high, high])
            docs, at = [], 0
            for k, (r, i) in enumerate(held):
                left[r] -= len(parts[k])
                words, first, own = int(counts[k]), open_doc.words - len(open_doc.low) if k == 0 else 0, open_doc.own if k == 0 else 0
                end = first + words if left[r] <= 0 else max(own, first + words - GAP)
                docs.append({"row": r, "doc_id": i, "first": first, "begin": at, "words": words, "own": own, "own_end": end})
                at += words + GAP
            yield _segment(number, docs, low, high)
            number += 1
            open_doc = Growing()
            if left[r] > 0:
                keep = min(2 * GAP, words)
                open_doc.words, open_doc.own, open_doc.low, open_doc.high = first + words, end, low[len(low) - keep :], high[len(high) - keep :]
    give_back()


def _segment(number: int, docs: list[dict], low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    words = np.array([d["words"] for d in docs], dtype=np.int64)
    begin = np.array([d["begin"] for d in docs], dtype=np.int64)
    at = np.arange(len(low)) + np.repeat(begin - (np.cumsum(words) - words), words)
    first, term = distinct(low, high) if len(low) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    postings = at[np.argsort(term, kind="stable")].astype(np.int32)
    starts = np.append(0, np.cumsum(np.bincount(term, minlength=len(first)))).astype(np.int32)
    steps = np.diff(postings, prepend=np.int32(0))  # small numbers pack well; they add up again modulo 2^32
    packed = [low[first].tobytes(), high[first].tobytes(), starts.tobytes(), steps.tobytes()]
    return pa.RecordBatch.from_pylist([{"segment": number, "docs": docs, **dict(zip(("low", "high", "starts", "steps"), packed, strict=True))}], schema=SEGMENT_TYPE)


SEGMENT_TYPE = pa.schema(
    [
        ("segment", pa.int64()),
        ("docs", pa.list_(pa.struct([("row", pa.int64()), ("doc_id", pa.string()), ("first", pa.int64()), ("begin", pa.int32()), ("words", pa.int32()), ("own", pa.int64()), ("own_end", pa.int64())]))),
        *((c, pa.binary()) for c in ("low", "high", "starts", "steps")),
    ]
)


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The stored index of a table of documents, a row a segment."""
    with batch_bytes(docs.sparkSession):
        return stored(docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(segments, INDEX))


def indexed_documents(index: DataFrame) -> DataFrame:
    """(row, doc_id, n_words) of every document of an index."""
    parts = index.select(F.inline("docs")).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("own_end") - F.col("own")).alias("n_words"))
    return parts.select("row", "doc_id", "n_words")


TESTS = "block long, items array<string>, bounds binary, low binary, high binary, words binary"


def pack_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) items as blocks: distinct words, and each item as numbers of these."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number = context.partitionId() << 32 if context else 0
    for batch in slices(batches):
        for ids, texts in pieces(batch.column("id").to_pylist(), batch.column("text"), INNER, 1 << 62):
            low, high, owner = keys_of(texts)
            counts = np.bincount(owner, minlength=len(texts))
            ends = np.cumsum(counts)
            k = 0
            while k < len(ids):
                a = int(ends[k] - counts[k])
                stop = max(k + 1, int(np.searchsorted(ends, a + BLOCK, side="right")))
                b = int(ends[stop - 1])
                if b > a:
                    first, term = distinct(low[a:b], high[a:b])
                    bounds = np.append(a, ends[k:stop]) - a
                    made = [number, ids[k:stop], bounds.astype(np.int64).tobytes(), low[a:b][first].tobytes(), high[a:b][first].tobytes(), term.astype(np.int64).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in made], names=[c.split()[0] for c in TESTS.split(", ")])
                    number += 1
                k = stop


class Segment:
    """A segment's words and postings."""

    def __init__(self, row: dict):
        self.docs = row["docs"]
        self.low, self.high = (np.frombuffer(row[c], dtype=np.uint64) for c in ("low", "high"))
        self.starts = np.frombuffer(row["starts"], dtype=np.int32).astype(np.int64)
        postings = np.cumsum(np.frombuffer(row["steps"], dtype=np.int32), dtype=np.int32).astype(np.int64)
        self.short = blend(self.low, self.high)
        self.order = None if (self.short[1:] > self.short[:-1]).all() else np.argsort(self.short, kind="stable")
        self.span = int(postings.max(initial=0)) + 2 * GAP
        #: word * span + position of every posting, ascending
        self.places = np.repeat(np.arange(len(self.low)), np.diff(self.starts)) * self.span + postings
        self.postings = postings

    def numbers(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each word in the segment, -1 where it has none."""
        if not len(self.low):
            return np.full(len(low), -1)
        wanted = blend(low, high)
        at = np.searchsorted(self.short, wanted, sorter=self.order)
        at = np.minimum(at, len(self.low) - 1)
        at = at if self.order is None else self.order[at]
        found = np.where((self.low[at] == low) & (self.high[at] == high), at, -1)
        if self.order is not None:  # words of one short key: look at them all
            for k in np.flatnonzero((found < 0) & np.isin(wanted, self.short)).tolist():
                same = np.flatnonzero((self.low == low[k]) & (self.high == high[k]))
                found[k] = same[0] if len(same) else -1
        return found

    def within(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the postings of words that lie in [low, high]."""
        low = np.maximum(low, 0)
        return np.searchsorted(self.places, word * self.span + low), np.searchsorted(self.places, word * self.span + np.minimum(high, self.span - 1), side="right")


def windows_of(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and item of every window."""
    n = np.diff(bounds)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    item = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][item]
    return first, np.minimum(n[item], size), item


def occurrences(segment: Segment, numbers: np.ndarray, words: np.ndarray, first: np.ndarray, length: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, position of its first word) of all matches, a number of windows at a time."""
    size = int(length.max(initial=0))
    at = first[:, None] + np.arange(size)
    inside = np.arange(size) < length[:, None]
    term = np.where(inside, numbers[words[np.minimum(at, len(words) - 1)]] if len(words) else -1, -2)
    alive = np.flatnonzero((term != -1).all(axis=1))
    term, length = term[alive], length[alive]
    freq = np.where(term < 0, 1 << 40, np.diff(segment.starts, append=segment.starts[-1:])[term])
    order = np.argsort(freq, axis=1, kind="stable")
    rarest = order[:, 0] if len(order) else np.zeros(0, dtype=np.int64)
    n = freq[np.arange(len(alive)), rarest] if len(alive) else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(n)
    low = 0
    while low < len(alive):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - n[low] + CANDIDATES, side="right")))
        w = np.repeat(np.arange(low, high), n[low:high])
        k = np.arange(len(w)) - np.repeat(ends[low:high] - n[low:high] - (ends[low] - n[low]), n[low:high])
        place = segment.postings[segment.starts[term[w, rarest[w]]] + k] - rarest[w]
        if slop:  # where the first word stands, for which the rarest is near its place
            a, b = segment.within(term[w, 0], place - slop, place + slop)
            w, place = np.repeat(w, b - a), segment.postings[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))]
            both = np.unique(w * segment.span + place)
            w, place = both // segment.span, both % segment.span
        w, place = w[place >= 0], place[place >= 0]
        for r in range(0 if slop else 1, size):
            offset = order[w, r]
            word = term[w, offset]
            a, b = segment.within(word, place + offset - slop, place + offset + slop)
            ok = (b > a) | (word < 0)
            w, place = w[ok], place[ok]
            if not len(w):
                break
        if len(w):
            yield alive[w], place
        low = high


MATCHES = "row long, item_id string, item_start long, start long, words int"
HITS = "row long, item_id string, start long, stop long"


def search_rows(window: int, slop: int, merged: bool):
    """Matches in pairs of a segment and a block of items; merged: a document's matches with an item as disjoint spans."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                yield from find(row, window, slop, merged)

    return run


def find(row: dict, window: int, slop: int, merged: bool) -> Iterator[pa.RecordBatch]:
    segment = Segment(row)
    bounds, words = (np.frombuffer(row[c], dtype=np.int64) for c in ("bounds", "words"))
    numbers = segment.numbers(*(np.frombuffer(row[c], dtype=np.uint64) for c in ("t_low", "t_high")))
    first, length, item = windows_of(bounds, window)
    begin, base, own, end = (np.array([d[c] for d in segment.docs], dtype=np.int64) for c in ("begin", "first", "own", "own_end"))
    rows, items = pa.array([d["row"] for d in segment.docs], pa.int64()), pa.array(row["items"], pa.string())
    held: list[tuple] = []
    for w, place in occurrences(segment, numbers, words, first, length, slop):
        doc = np.searchsorted(begin, place, side="right") - 1
        start = place - begin[doc] + base[doc]
        if merged:
            held.append((doc, item[w], np.maximum(start, own[doc]), np.minimum(start + length[w], end[doc])))
            continue
        mine = (start >= own[doc]) & (start < end[doc])  # the next segment repeats the others
        doc, w, start = doc[mine], w[mine], start[mine]
        columns = [rows.take(pa.array(doc)), items.take(pa.array(item[w])), pa.array(first[w] - bounds[item[w]]), pa.array(start), pa.array(length[w].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MATCHES.split(", ")])
    if held:
        doc, what, start, stop = (np.concatenate(c) for c in zip(*held, strict=True))
        some = stop > start
        doc, what, start, stop = doc[some], what[some], start[some], stop[some]
        order = np.lexsort((start, what, doc))
        doc, what, start, stop = doc[order], what[order], start[order], stop[order]
        # spans of one document and item are disjoint once those that touch are joined
        group = np.cumsum(np.append(True, (np.diff(doc) != 0) | (np.diff(what) != 0))) if len(doc) else np.zeros(0, np.int64)
        far = int(stop.max(initial=0)) + 1
        reach = np.maximum.accumulate(group * far + stop)
        fresh = np.flatnonzero(np.append(True, (group * far + start)[1:] > reach[:-1])) if len(doc) else np.zeros(0, np.int64)
        stops = reach[np.append(fresh[1:], len(doc)) - 1] - group[fresh] * far if len(doc) else stop
        columns = [rows.take(pa.array(doc[fresh])), items.take(pa.array(what[fresh])), pa.array(start[fresh]), pa.array(stops)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HITS.split(", ")])


def _pairs(index: DataFrame, items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Every segment with every block of items, dealt by a shard of the segments."""
    spark = index.sparkSession
    tests = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).filter("text is not null")
    tests = stored(tests.mapInArrow(pack_items, TESTS)).withColumnsRenamed({"low": "t_low", "high": "t_high"}).drop("block")
    size = tests.agg(F.sum(sum((F.octet_length(c) for c in ("bounds", "t_low", "t_high", "words")), F.lit(0)) + F.octet_length(F.array_join("items", ",")))).first()[0] or 0
    few = size <= SMALL
    shards = 1 if few else int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = index.withColumn("shard", F.expr(f"pmod(xxhash64(segment), {shards})").cast("int"))
    right = tests.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left.join(F.broadcast(right) if few else right, "shard")


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(row, item_id, item_start, start, words) of every place of an index where a window of an item begins.

    ``row`` is the document's in ``indexed_documents``; starts are numbers of words.  With ``slop`` all words of the window stand
    within so many words of their places, counted from the first word; the exact phrases are among these.
    """
    if window + slop > GAP:
        raise ValueError(f"window and slop span at most {GAP} words")
    with batch_bytes(index.sparkSession):
        return stored(_pairs(index, items, item_id, text).mapInArrow(search_rows(window, slop, False), MATCHES))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document; see the module."""
    index = build_index(docs)
    with batch_bytes(docs.sparkSession):
        hits = stored(_pairs(index, items, "item_id", "text").mapInArrow(search_rows(window, 0, True), HITS))
    spans_ = F.array_sort(F.collect_list(F.struct("start", "stop")))
    of_doc = hits.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"), spans_.alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))

    def join(acc, x):
        covered = F.greatest(x["stop"] - F.greatest(x["start"], acc["end"]), F.lit(0).cast("long"))
        return F.struct((acc["n"] + covered).alias("n"), F.greatest(acc["end"], x["stop"]).alias("end"))

    told = of_doc.select("row", "items", F.aggregate("spans", start, join)["n"].alias("hit"))
    every = indexed_documents(index).join(told, "row", "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    doc_id = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    return every.select(doc_id.alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
