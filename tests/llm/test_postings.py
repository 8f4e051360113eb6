"""The positional index and its search against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import postings
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def windows(items, size=10):
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            yield item, k, w[k : k + size]


def brute(docs, items, size=10):
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, _, win in windows(items, size):
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def brute_matches(docs, items, size, slop):
    out = set()
    for n, (_, text) in enumerate(docs):
        w = words_of(text)
        for item, at, win in windows(items, size):
            for p in range(len(w)):
                if w[p] == win[0] and all(x in w[max(0, p + k - slop) : p + k + slop + 1] for k, x in enumerate(win)):
                    out.add((n, str(item), at, p, len(win)))
    return sorted(out)


def made(seed=4, n=40):
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in np.minimum(rng.zipf(1.3, k), 60)]
    items = [(k, word(int(rng.integers(1, 40)))) for k in range(12)]
    docs = []
    for k in range(n):
        w = word(int(rng.integers(0, 120)))
        if k % 3 == 0:
            passage = items[k % 12][1]
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = passage[k % 5 :][: 30 - k % 7]
        docs.append((k, ". ".join(w).upper() if k % 2 else " ".join(w)))
    return docs, [(k, " ".join(w)) for k, w in items]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def told(docs, items, **options):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(map(tuple, postings.contamination(docs, items, **options).select(*columns).collect()), key=str)


def test_made_documents(spark):
    docs, items = made()
    want = brute(docs, items)
    assert told(*frames(spark, docs, items)) == want and sum(r[-1] for r in want) > 10
    assert told(*frames(spark, docs, items), window=3) == brute(docs, items, 3)


def test_more_blocks_than_fit_a_broadcast(spark, monkeypatch):
    docs, items = made(9)
    monkeypatch.setattr(postings, "SMALL", 0)
    monkeypatch.setattr(postings, "BLOCK", 30)
    docs_frame, items_frame = frames(spark, docs, items)
    assert told(docs_frame, items_frame.repartition(5)) == brute(docs, items)


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_phrases_and_proximity(spark, slop):
    docs, items = made(2, 15)
    items = items[:5]
    index = postings.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    row = {r.row: int(r.doc_id) for r in postings.indexed_documents(index).collect()}
    got = postings.matches(index, spark.createDataFrame(items, "item_id long, text string"), window=4, slop=slop).collect()
    assert sorted((row[r.row], r.item_id, r.item_start, r.start, r.words) for r in got) == brute_matches(docs, items, 4, slop) and len(got) > 5


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert told(docs, items) == want and any(r[-1] for r in want)


def test_odd_rows(spark, odd, nothing):
    items = [(1, "one two three"), (2, ""), (3, None), (None, "déjà vu"), (4, "from " * 12), (4, "ONE, two! three"), (5, "x" * 70_000), (6, "日本語 endoftext it"), (7, "no")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert told(odd, frame) == brute(docs, items)
    assert told(nothing, frame) == []
    assert told(odd, frame.limit(0)) == brute(docs, [])


@pytest.mark.parametrize("limit", [50, 700, 5000])
def test_long_documents_go_on_in_the_next_segments(limit):
    rng = np.random.default_rng(limit)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 30, k)]
    items = [(k, " ".join(word(n))) for k, n in enumerate((4, 12, 25))]
    long = word(3000)
    for at in range(0, 2900, 97):
        w = items[at % 3][1].split()
        long[at : at + len(w)] = w
    docs = [(0, "first w1 w2"), (1, " ".join(long)), (2, None), (3, items[1][1]), (4, " ".join(long[:700]) + " " + "y" * 6000)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k, _ in docs]), pa.array([t for _, t in docs])], names=["id", "text"])
    tests = [b.to_pylist()[0] for b in postings.pack_items(iter([pa.RecordBatch.from_arrays([pa.array([str(k) for k, _ in items]), pa.array([t for _, t in items])], names=["id", "text"])]))]
    n_words, hits = dict.fromkeys(range(5), 0), {k: {} for k in range(5)}
    count = 0
    for segment in postings.segments(iter([batch]), limit):
        row = segment.to_pylist()[0]
        count += 1
        for d in row["docs"]:
            n_words[int(d["doc_id"])] += d["own_end"] - d["own"]
        for t in tests:
            for b in postings.find(row | {"items": t["items"], "bounds": t["bounds"], "words": t["words"], "t_low": t["low"], "t_high": t["high"]}, 10, 0, True):
                for h in b.to_pylist():
                    hits[h["row"]].setdefault(h["item_id"], set()).update(range(h["start"], h["stop"]))
    got = []
    for k in range(5):
        every = set().union(*hits[k].values())
        got.append((k, n_words[k], len(every), len(hits[k]), hashlib.sha256(",".join(sorted(hits[k])).encode()).hexdigest(), bool(every)))
    assert got == brute(docs, items) and count > 17_000 // limit // 2
