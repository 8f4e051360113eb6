"""Spelling variants against brute force over all pairs, on tables, odd rows and long texts."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import spelling, textkit


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_counts(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(counts):
    near = collections.defaultdict(list)
    by_size = collections.defaultdict(list)
    for w in counts:
        by_size[len(w)].append(w)
    for w in counts:
        near[w] = [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by_size[size] if x != w and one_edit(w, x)]
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def found(docs):
    return sorted(map(tuple, spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def planted(words):
    """Texts in which words and their variants occur 1 to 40 times."""
    rng = np.random.default_rng(5)
    letters = "abé"
    vocabulary = {"".join(rng.choice(list(letters), rng.integers(5, 9))) for _ in range(words)}
    vocabulary |= {w[:2] + w[3:] for w in list(vocabulary)[::3]} | {w + "s" for w in list(vocabulary)[::4]} | {"x" + w for w in list(vocabulary)[::5]}
    text = [w for w in sorted(vocabulary) for _ in range(int(rng.integers(1, 40)))]
    rng.shuffle(text)
    return [(k, " ".join(text[k::50])) for k in range(50)]


@pytest.mark.parametrize("tile", [1024, 7, 40])
def test_planted_words_over_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    rows = planted(500)
    want = brute(brute_counts(rows))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert sum(r[4] > 3 for r in want) > 50 and len({r[2] for r in want if r[1] != r[2]}) > 10


def test_stacked_and_dense_blocks_agree(spark, monkeypatch):
    counts = brute_counts(planted(300))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    batches = spelling.tile_pairs(words).toArrow().to_batches()
    told = []
    for stack, pairs in ((0, 1), (5, 50), (10_000, 1 << 18)):
        monkeypatch.setattr(spelling, "STACK", stack)
        monkeypatch.setattr(spelling, "PAIRS", pairs)
        told.append(sorted(tuple(r.values()) for b in spelling.compare(iter(batches)) for r in b.to_pylist()))
    assert told[0] == told[1] == told[2] and len(told[0]) > 300


def test_documents(spark, small):
    docs = small.filter("doc_id < 60")
    assert found(docs) == brute(brute_counts([(r.doc_id, r.text) for r in docs.collect()]))


def test_odd_rows(odd, nothing):
    assert found(odd) == brute(brute_counts([(r.doc_id, r.text) for r in odd.collect()]))
    assert found(nothing) == []


def test_names_that_clash_and_other_columns(spark):
    rows = planted(60)
    docs = spark.createDataFrame([(t, i, 1, "n", "w") for i, t in rows], "text string, doc_id long, n int, word string, root string")
    assert found(docs) == brute(brute_counts(rows))


def test_crc_by_parts():
    rng = np.random.default_rng(2)
    prefixes = [f"{k}:".encode() for k in rng.integers(0, 10**12, 20)]
    words = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(1, 200, 300)]
    owner = rng.integers(0, 20, 300)
    got = spelling.prefixed_crcs(
        np.array([zlib.crc32(p) for p in prefixes], dtype=np.uint32), owner, np.array([zlib.crc32(w) for w in words], dtype=np.uint32), np.array([len(w) for w in words])
    )
    assert got.tolist() == [zlib.crc32(prefixes[o] + w) for o, w in zip(owner, words, strict=True)]


def test_a_long_text_is_counted_in_pieces():
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdé"), 6)) for _ in range(4000)) + " " + "long" * 3000 + " é"
    texts = pa.array([None, "first words", text, "", "last words"])
    cut = list(textkit.pieces([0, 1, 2, 3, 4], texts, spelling.LETTER, 1000))
    assert max(sum(map(len, t)) for _, t in cut) < 14_000 and len(cut) > 20
    assert b"".join(t for ids, part in cut for i, t in zip(ids, part, strict=True) if i == 2).decode() == text
    total = collections.Counter()
    for ids, part in cut:
        total += spelling.count_piece([str(i) for i in ids], part)
    assert {w: n for w, n in total.items() if n >= 3} == brute_counts([(1, "first words"), (2, text), (4, "last words")])


def test_words_beyond_one_byte():
    words = pa.array(["日本語です", "日本語でせ", "日本語", "日本語でした", "x" * 300, "x" * 301])
    a = spelling.Block(words.slice(0, 2), 5)
    assert spelling.near_dense(a, a, 5, 0).tolist() == [[True, True], [True, True]]
    b = spelling.Block(words.slice(4, 2), 301)
    assert spelling.near_dense(b, b, 301, 0).tolist() == [[False, True], [True, True]]
