"""Quality rules with suffix-array repetition.

A suffix array over the words of every text is built by prefix doubling (only suffixes that still
tie are sorted again), for all texts of a batch at once; words are compared as exact numbers.  The longest
common prefixes of neighbours come from the kept ranks.  They form LCP intervals: each interval of depth d is a
maximal repeated substring of d words, its slots are the places where it occurs.  A place counts with the
deepest interval that holds it.  The union of these spans, for repeats of at least ``MIN_REPEAT`` words, must
not cover more than ``MAX_COVERED`` of the words, and no repeat may be longer than ``MAX_REPEAT`` words.

Memory: about 120 bytes a word of a batch (4 MB of text, or one longer text, which is processed whole: 300 MB for 4 million
words); up to 210 where nearly all of a text repeats at every length.

Edge cases: a null or empty text has no words and fails the base rules; any length is processed
whole; repeated rows get equal results; other columns are dropped; an empty table stays empty.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import U64, Texts, as_bytes, distinct, slices, span_keys

#: Base rules: least words, words of a repeated window, most per cent of words in repeated windows.
MIN_WORDS, WINDOW, MAX_WINDOW_PERCENT = 20, 8, 30
#: Method's rules: shortest repeat that counts, largest share of covered words, longest repeat.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 12, 0.2, 100

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


class Level:
    """Ranks by the first 2^k words of the suffixes that share them with another; the others equal none."""

    def __init__(self, rank: np.ndarray, slots: np.ndarray, tied: np.ndarray):
        at = np.sort(slots[tied])
        # few suffixes as a list, many as a table
        self.at = at if 3 * len(at) < len(rank) else None
        self.rank = rank[at] if self.at is not None else np.full(len(rank), -1, dtype=np.int32)
        if self.at is None:
            self.rank[at] = rank[at]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self._of(a), self._of(b)
        return (x == y) & (x >= 0)

    def _of(self, suffix: np.ndarray) -> np.ndarray:
        if self.at is None:
            return self.rank[suffix]
        if not len(self.at):
            return np.full(len(suffix), -1, dtype=np.int32)
        k = np.minimum(np.searchsorted(self.at, suffix), len(self.at) - 1)
        return np.where(self.at[k] == suffix, self.rank[k], -1)


def suffix_array(words: np.ndarray, owner: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all texts in order (grouped by text and first word), and the common prefix of each with the next, in words.

    words: exact numbers of the words; owner: index of the text; stop: end of the word's text.
    """
    n = len(words)
    slots = np.argsort(keys := owner.astype(np.int64) * (int(words.max()) + 1 if n else 1) + words, kind="stable").astype(np.int32)
    common = np.zeros(max(n - 1, 0), dtype=np.int32)
    if n == 0:
        return slots, common
    ordered = keys[slots]
    new = np.append(True, ordered[1:] != ordered[:-1])
    del keys, ordered
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int32)
    rank[slots] = group
    tied = ~(new & np.append(new[1:], True))  # slots in groups of two or more
    levels = [Level(rank, slots, tied)]
    h = 1
    while tied.any():
        at = np.flatnonzero(tied)
        suffix = slots[at]
        ahead = suffix.astype(np.int64) + h
        inside = ahead < stop[suffix]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)], -1) + 1
        order = np.argsort(rank[suffix].astype(np.int64) * (n + 1) + second, kind="stable")
        suffix, second = suffix[order], second[order]
        first = rank[suffix]
        slots[at] = suffix
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        rank[suffix] = np.maximum.accumulate(np.where(new, at, 0))
        tied[at] = ~(new & np.append(new[1:], True))
        levels.append(Level(rank, slots, tied))
        h *= 2
    # neighbours: common prefix, from the longest level down
    pairs = np.flatnonzero(levels[0].equal(slots[:-1], slots[1:]))
    left, right = slots[:-1][pairs], slots[1:][pairs]
    found = np.zeros(len(pairs), dtype=np.int32)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + found, right + found
        ok = np.flatnonzero((a < stop[left]) & (b < stop[right]))
        found[ok[levels[k].equal(a[ok], b[ok])]] += 1 << k
    common[pairs] = found
    return slots, common


def lcp_intervals(common: Iterable[int], least: int = 1) -> Iterator[tuple[int, int, int]]:
    """(lcp, first slot, last slot) of every LCP interval of ``least`` words or more, inner ones before outer ones, from the lcp of neighbouring slots."""
    stack = [(0, 0)]
    for i, value in enumerate(itertools.chain(common, [0])):
        value = value if value >= least else 0
        begin = i
        while stack[-1][0] > value:
            depth, begin = stack.pop()
            yield depth, begin, i
        if stack[-1][0] < value:
            stack.append((value, begin))


def deepest_intervals(common: np.ndarray, n: int, least: int) -> np.ndarray:
    """By slot, the depth of the deepest LCP interval of ``least`` words or more that holds it (0: none)."""
    depth = np.zeros(n, dtype=np.int32)
    deep = common >= least
    edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # slots a .. b hang together
        free = array("i", range(b - a + 2))  # next slot without a depth, with shortened paths
        own = array("i", bytes(4 * (b - a + 1)))
        for d, i, j in lcp_intervals(array("i", common[a:b].astype(np.int32).tobytes()), least):
            k = i
            while True:
                while free[k] != k:
                    free[k] = free[free[k]]
                    k = free[k]
                if k > j:
                    break
                own[k] = d
                free[k] = k + 1
        depth[a : b + 1] = own
    return depth


def longest_repeats(words: np.ndarray, owner: np.ndarray, stop: np.ndarray, least: int = 1) -> np.ndarray:
    """For each word, the words of the longest string from there that occurs twice in its text (0 below ``least``)."""
    slots, common = suffix_array(words, owner, stop)
    result = np.zeros(len(words), dtype=np.int32)
    result[slots] = deepest_intervals(common, len(words), least)
    return result


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in the union of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge)[:-1] > 0


def _by_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(raw: list[bytes | None], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    t = Texts(raw)
    n = len(t.starts)
    owner = t.owner()
    stop = np.repeat(t.words[1:], t.n_words)
    repeat = longest_repeats(t.ids(), owner, stop, min(WINDOW, min_repeat))
    bounds = np.append(t.begin, len(t.bytes))
    blank_free = ~np.isin(t.bytes, np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))
    # lines with a word, by text; the newline after each text ends its last line
    stops = np.flatnonzero(t.bytes == 10)
    begins = np.append(0, stops[:-1] + 1) if len(stops) else stops
    filled = np.append(0, np.cumsum(blank_free, dtype=np.int64))
    has = filled[stops] > filled[begins]
    begins, stops = begins[has], stops[has]
    line_of = np.searchsorted(t.end, begins)
    first, _ = distinct(*span_keys(t.raw, begins, stops), line_of.astype(U64))
    at = np.flatnonzero(repeat >= WINDOW)
    long = np.flatnonzero(repeat >= min_repeat)
    longest = np.zeros(t.count, dtype=np.int64)
    np.maximum.at(longest, owner, repeat)
    return {
        "n_words": t.n_words.astype(np.int64),
        "word_chars": _by_text(blank_free & ((t.bytes & 0xC0) != 0x80), bounds),
        "n_symbols": _by_text(SYMBOL[t.bytes], bounds),
        "n_dup_lines": np.bincount(line_of, minlength=t.count) - np.bincount(line_of[first], minlength=t.count),
        "n_repeat_words": _by_text(covered(at, np.full(len(at), WINDOW), n), t.words),
        "covered_words": _by_text(covered(long, repeat[long], n), t.words),
        "longest_repeat": longest,
    }


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean"


def repetition_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Measures and verdict of every document."""

    def run(batches):
        for b in slices(batches):
            m = measure(as_bytes(b.column("text")), min_repeat)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_WINDOW_PERCENT * m["n_words"])
            kept = ~failed & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(m[c], type=pa.int64()) for c in COLUMNS), pa.array(failed), pa.array(kept)], names=["doc_id", *COLUMNS, "base_failed", "kept"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def keep_rows(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns, in one pass and without a join."""
    schema = docs.schema

    def run(batches):
        for b in slices(batches):
            m = measure(as_bytes(b.column("text")))
            kept = (m["n_words"] >= MIN_WORDS) & (100 * m["n_repeat_words"] <= MAX_WINDOW_PERCENT * m["n_words"])
            kept &= (m["covered_words"] <= MAX_COVERED * m["n_words"]) & (m["longest_repeat"] <= MAX_REPEAT)
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, schema)
