"""Regular expressions with longest and shortest matches, sets of them, and maximal-munch tokens.

Expressions are built from nodes.  ``java`` gives the pattern for Spark's own functions, which are right
for whole matches and for the first, shortest match.  A longest match is beyond a leftmost-first engine:
``Automaton`` builds a deterministic automaton from the nodes, and the Arrow UDFs here run it over a batch in time that grows
with the texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

#: Most characters of a chunk.
CHUNK = 1024
#: Most characters of a lone text that is walked without tables.
WALKED = 256


@dataclass(frozen=True)
class Node:
    kind: str  #: empty, chars, then, either or star
    parts: tuple = ()
    chars: frozenset = frozenset()

    def __add__(self, other: Node) -> Node:
        return Node("then", (self, other))

    def __or__(self, other: Node) -> Node:
        return Node("either", (self, other))

    def star(self) -> Node:
        return Node("star", (self,))

    def java(self, lazy: bool = False) -> str:
        """A pattern for java.util.regex."""
        if self.kind == "empty":
            return "(?:)"
        if self.kind == "chars":
            return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(self.chars)) + "]"
        inner = [p.java(lazy) for p in self.parts]
        if self.kind == "then":
            return "".join(f"(?:{p})" for p in inner)
        if self.kind == "either":
            return "(?:" + "|".join(inner) + ")"
        return f"(?:{inner[0]})*" + ("?" if lazy else "")


EMPTY = Node("empty")


def literal(text: str) -> Node:
    out = EMPTY
    for c in text:
        out = out + Node("chars", (), frozenset(c))
    return out


def charset(chars: str) -> Node:
    if not chars:
        raise ValueError("empty character set")
    return Node("chars", (), frozenset(chars))


class Automaton:
    """Deterministic automaton of several expressions at once; a state knows which of them accept."""

    def __init__(self, *nodes: Node):
        self._moves: list[list[tuple[frozenset | None, int]]] = []
        start, ends = self._state(), {}
        for k, node in enumerate(nodes):
            a, b = self._build(node)
            self._moves[start].append((None, a))
            ends[b] = k
        alphabet = sorted({c for moves in self._moves for chars, _ in moves if chars for c in chars})
        first = self._closure({start})
        known, work = {first: 0}, [first]
        self.table: list[dict[str, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        while len(self.table) < len(work):
            here = work[len(self.table)]
            row: dict[str, int] = {}
            for c in alphabet:
                to = self._closure({t for s in here for chars, t in self._moves[s] if chars and c in chars})
                if to:
                    if to not in known:
                        known[to] = len(work)
                        work.append(to)
                    row[c] = known[to]
            self.table.append(row)
            self.accepts.append(tuple(sorted(ends[s] for s in here if s in ends)))
        del self._moves
        self.tables = Tables(self)

    def _state(self) -> int:
        self._moves.append([])
        return len(self._moves) - 1

    def _build(self, node: Node) -> tuple[int, int]:
        a, b = self._state(), self._state()
        if node.kind == "empty":
            self._moves[a].append((None, b))
        elif node.kind == "chars":
            self._moves[a].append((node.chars, b))
        elif node.kind == "then":
            (x, y), (z, w) = map(self._build, node.parts)
            self._moves[a].append((None, x))
            self._moves[y].append((None, z))
            self._moves[w].append((None, b))
        else:
            loop = node.kind == "star"
            for part in node.parts:
                x, y = self._build(part)
                self._moves[a].append((None, x))
                self._moves[y].append((None, b))
                if loop:
                    self._moves[y].append((None, x))
            if loop:
                self._moves[a].append((None, b))
        return a, b

    def _closure(self, states: set[int]) -> frozenset[int]:
        work, seen = list(states), set(states)
        while work:
            for chars, to in self._moves[work.pop()]:
                if chars is None and to not in seen:
                    seen.add(to)
                    work.append(to)
        return frozenset(seen)

    def match(self, text: str, at: int = 0, longest: bool = True) -> tuple[int, tuple[int, ...]]:
        """Length of the longest (or shortest) match from ``at``, -1 if none, and which expressions accept it."""
        state, best = 0, (-1, ())
        i = at
        while True:
            if self.accepts[state]:
                best = (i - at, self.accepts[state])
                if not longest:
                    return best
            if i == len(text) or text[i] not in self.table[state]:
                return best
            state = self.table[state][text[i]]
            i += 1

    def find_long(self, text: str) -> tuple[int, int]:
        """(start, length) of the longest match anywhere, the leftmost of equals; (-1, -1) if none."""
        start, length = self.tables.find_long([text])
        return int(start[0]), int(length[0])

    def find_first(self, text: str) -> tuple[int, int]:
        """(start, length) of the leftmost match at its shortest; (-1, -1) if none."""
        start, length = self.tables.find_first([text])
        return int(start[0]), int(length[0])

    def tokens(self, text: str) -> tuple[list[tuple[str, list[int]]], str]:
        """Maximal-munch tokens with all types that fit, and what is left at the first place without a match."""
        if len(text) <= WALKED:
            out, i = [], 0
            while i < len(text):
                n, kinds = self.match(text, i)
                if n <= 0:
                    break
                out.append((text[i : i + n], list(kinds)))
                i += n
            return out, text[i:]
        found = next(self.tables.tokens([text]))
        at = [0, *(stop for stop, _ in found)]
        return [(text[i:j], list(self.accepts[k])) for i, j, (_, k) in zip(at, at[1:], found, strict=False)], text[at[-1] :]


class Tables:
    """An automaton as dense tables (states by classes of characters), run over many texts at once.

    For every place of a text the match that begins there is wanted, in time that grows with the text alone.  It follows from
    the place after it: the match from place i in state s goes on as the match from i + 1 in the state that the character leads to.
    Texts are cut into chunks, and all chunks are walked from their ends together, one character a step, for every state.  What a
    chunk does not decide itself depends on the state in which it is left, so chunks are joined afterwards, from the last to the first.
    """

    def __init__(self, auto: Automaton):
        letters = sorted({c for row in auto.table for c in row})
        self.letters = np.array([ord(c) for c in letters], dtype=np.uint32)
        n = len(auto.table)
        self.dead, self.kinds = n, n + 1
        #: by class and state, the next state; the last class is any other character
        self.moves = np.full((len(letters) + 1, n + 1), n, dtype=np.int32)
        place = {c: k for k, c in enumerate(letters)}
        for state, row in enumerate(auto.table):
            for c, to in row.items():
                self.moves[place[c], state] = to
        self.accepts = np.array([bool(a) for a in auto.accepts] + [False])

    def classes(self, text: np.ndarray) -> np.ndarray:
        if not len(self.letters):
            return np.zeros(len(text), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.letters, text), len(self.letters) - 1)
        return np.where(self.letters[at] == text, at, len(self.letters)).astype(np.int32)

    def ends(self, texts: list[str], longest: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """For every place of every text (the one after its last character too) the end of the match from there times ``kinds``
        plus the state that accepts, -1 if there is none; and the bounds of the texts."""
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        text = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = np.cumsum(size) - size
        width = int(np.clip(2 * len(text) // max(1, len(texts)), 16, CHUNK))
        count = np.maximum(-(-size // width), 1)
        owner = np.repeat(np.arange(len(texts)), count)
        last = np.cumsum(count) - 1
        low = (np.arange(len(owner)) - (last - count + 1)[owner]) * width  # place of a chunk's first character
        own = np.minimum(size[owner] - low, width)
        order = np.argsort(-own, kind="stable")  # the chunks that are long enough for a step come first
        low, own, source = low[order], own[order], begin[owner[order]]
        inside, left, first, exits = self._walk(self.classes(text), low, own, source, width, longest)
        # what the rest of the text makes of the state in which each chunk is left
        rest = np.full((len(owner), self.kinds), -1, dtype=np.int64)
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.arange(len(order))
        rest[at[last]] = np.where(self.accepts, size[:, None] * self.kinds + np.arange(self.kinds), -1)
        for k in range(1, int(count.max(initial=1))):
            some = np.flatnonzero(count > k)
            here, after = at[last[some] - k], at[last[some] - k + 1]
            rest[here] = _join(first[after], np.take_along_axis(rest[after], exits[after], axis=1), longest)
        out = np.full(len(text) + len(texts), -1, dtype=np.int64)
        bounds = np.append(0, np.cumsum(size + 1))
        step, lane = np.nonzero(np.arange(width)[:, None] < own[None, :])
        whole = _join(inside[step, lane], rest[lane, left[step, lane]], longest)
        out[(bounds[:-1][owner[order]] + low)[lane] + step] = whole
        if self.accepts[0]:
            out[bounds[1:] - 1] = size * self.kinds
        return out, bounds

    def _walk(self, classes: np.ndarray, low: np.ndarray, own: np.ndarray, source: np.ndarray, width: int, longest: bool):
        """By step and chunk: the match from state 0 that ends inside the chunk, and the state in which it is left; by chunk and
        state the same at its begin."""
        lanes = len(low)
        found = np.full((lanes, self.kinds), -1, dtype=np.int64)
        exits = np.tile(np.arange(self.kinds, dtype=np.int32), (lanes, 1))
        inside, left = np.full((width, lanes), -1, dtype=np.int64), np.zeros((width, lanes), dtype=np.int32)
        states = np.arange(self.kinds)
        for step in range(width - 1, -1, -1):
            n = int(np.searchsorted(-own, -step, side="left"))  # chunks with more characters than that
            if not n:
                continue
            to = self.moves[classes[source[:n] + low[:n] + step]]
            ahead = np.take_along_axis(found[:n], to, axis=1)
            exits[:n] = np.take_along_axis(exits[:n], to, axis=1)
            here = np.where(self.accepts, (low[:n, None] + step) * self.kinds + states, -1)
            found[:n] = _join(here, ahead, longest)
            inside[step, :n], left[step, :n] = found[:n, 0], exits[:n, 0]
        return inside, left, found, exits

    def find_long(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each text's longest match, the leftmost of equals; -1 if none."""
        out, bounds = self.ends(texts)
        at = np.arange(len(out)) - np.repeat(bounds[:-1], np.diff(bounds))
        length = np.where(out < 0, -1, out // self.kinds - at)
        most = np.maximum.reduceat(length, bounds[:-1]) if len(texts) else length
        return _first(length == np.repeat(most, np.diff(bounds)), at, bounds, most), most

    def find_first(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each text's leftmost match at its shortest; -1 if none."""
        out, bounds = self.ends(texts, longest=False)
        at = np.arange(len(out)) - np.repeat(bounds[:-1], np.diff(bounds))
        any_ = np.maximum.reduceat(out, bounds[:-1]) if len(texts) else out
        start = _first(out >= 0, at, bounds, any_)
        return start, np.where(start < 0, -1, out[bounds[:-1] + np.maximum(start, 0)] // self.kinds - start)

    def tokens(self, texts: list[str]) -> Iterator[list[tuple[int, int]]]:
        """For each text the ends of its maximal-munch tokens and the states that accept them, up to the first place without one."""
        out, bounds = self.ends(texts)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            codes, at, found = out[low:high].tolist(), 0, []
            while at < high - low - 1:
                stop, state = divmod(codes[at], self.kinds)
                if codes[at] < 0 or stop == at:
                    break
                found.append((stop, state))
                at = stop
            yield found


def _join(near: np.ndarray, far: np.ndarray, longest: bool) -> np.ndarray:
    """Of two matches from one place, of which the first ends earlier, the one that is wanted."""
    return np.where(far >= 0, far, near) if longest else np.where(near >= 0, near, far)


def _first(mark: np.ndarray, at: np.ndarray, bounds: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The first marked place of each text, -1 where ``most`` is negative."""
    if not len(most):
        return np.zeros(0, dtype=np.int64)
    place = np.minimum.reduceat(np.where(mark, at, len(at)), bounds[:-1])
    return np.where(most < 0, -1, place)


def batches_of(texts: list[str | None], limit: int = 1 << 21) -> Iterator[list[int]]:
    """Numbers of the texts that are there, about ``limit`` characters at a time."""
    held: list[int] = []
    total = 0
    for k, t in enumerate(texts):
        if t is not None:
            held.append(k)
            total += len(t)
            if total >= limit:
                yield held
                held, total = [], 0
    if held:
        yield held


def matches(c: Column, node: Node) -> Column:
    """Whether the whole text matches."""
    return c.rlike(f"(?s)\\A(?:{node.java()})\\z")


def first_match(c: Column, node: Node) -> Column:
    """Text of the leftmost match, at its shortest; null if none.

    Lazy repeats give the shortest match unless an alternative that comes later is shorter, so an expression with alternatives goes
    to the automaton.
    """
    if has_choice(node):
        found = find_first_udf(node)(c)
        return F.when(found["start"] >= 0, F.substring(c, found["start"] + 1, found["length"]))
    pattern = F.lit(f"(?s){node.java(lazy=True)}")
    return F.when(F.regexp_like(c, pattern), F.regexp_substr(c, pattern))


def has_choice(node: Node) -> bool:
    """Whether an alternation occurs in the expression."""
    return node.kind == "either" or any(map(has_choice, node.parts))


def _finder(node: Node, method: str):
    tables = Automaton(node).tables

    @F.arrow_udf("struct<start: int, length: int>")
    def find(s: pa.Array) -> pa.Array:
        texts = s.to_pylist()
        found = np.full((2, len(texts)), -1, dtype=np.int32)
        for some in batches_of(texts):
            found[:, some] = getattr(tables, method)([texts[k] for k in some])
        missing = np.array([t is None for t in texts], dtype=bool)
        return pa.StructArray.from_arrays([pa.array(x, mask=missing) for x in found], names=["start", "length"])

    return find


def find_long_udf(node: Node):
    """Start and length of the longest match anywhere, the leftmost of equals; -1 if none."""
    return _finder(node, "find_long")


def find_first_udf(node: Node):
    """Start and length of the leftmost match at its shortest; -1 if none."""
    return _finder(node, "find_first")


TOKENS = "array<struct<text: string, types: array<int>>>"


def token_lists(auto: Automaton, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
    """Tokens (text, types) of each text, and the rest at the first place without one."""
    rows: list[list[tuple[int, int]]] = [[] for _ in texts]
    for some in batches_of(texts):
        for k, found in zip(some, auto.tables.tokens([texts[k] for k in some]), strict=True):
            rows[k] = found
    sizes = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
    words = [t[i:j] for t, r in zip(texts, rows, strict=True) if r for i, j in zip([0, *(e for e, _ in r)], [e for e, _ in r], strict=False)]
    states = pa.array([k for r in rows for _, k in r], pa.int32())
    types = pa.array([list(a) for a in auto.accepts], pa.list_(pa.int32())).take(states)
    entries = pa.StructArray.from_arrays([pa.array(words, pa.string()), types], names=["text", "types"])
    missing = [t is None for t in texts]
    lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), entries) if not any(missing) else pa.ListArray.from_arrays(pa.array([None if m else x for m, x in zip([*missing, False], sizes.tolist(), strict=True)], pa.int32()), entries)
    rest = pa.array([None if t is None else t[r[-1][0] if r else 0 :] for t, r in zip(texts, rows, strict=True)], pa.string())
    return lists, rest


def tokenize_udf(*nodes: Node):
    """An Arrow UDF: array<struct<text, types>>."""
    auto = Automaton(*nodes)

    @F.arrow_udf(TOKENS)
    def tokens(s: pa.Array) -> pa.Array:
        return token_lists(auto, s.to_pylist())[0]

    return tokens


def tokenize_with_rest_udf(*nodes: Node):
    """The same with what no token fits: struct<tokens, rest>."""
    auto = Automaton(*nodes)

    @F.arrow_udf(f"struct<tokens: {TOKENS}, rest: string>")
    def tokens(s: pa.Array) -> pa.Array:
        lists, rest = token_lists(auto, s.to_pylist())
        return pa.StructArray.from_arrays([lists, rest], names=["tokens", "rest"])

    return tokens


def register_tokenizer(spark: SparkSession, name: str, *nodes: Node) -> None:
    """A table function ``name(text)`` of the tokens of a text: place, token, types, and the text's rest that no token fits.

    A text without a token has no row; for ``LATERAL`` joins in SQL.
    """
    auto = Automaton(*nodes)

    class Tokens:
        def eval(self, text: str):
            if text is None:
                return
            found, rest = auto.tokens(text)
            for place, (token, types) in enumerate(found):
                yield place, token, types, rest

    spark.udtf.register(name, F.udtf(Tokens, returnType="place int, token string, types array<int>, rest string", useArrow=True))
