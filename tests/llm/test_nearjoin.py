import collections
import re

import numpy as np
import pytest

from strandline.llm import components, nearjoin
from tests.llm.conftest import thue_morse


def brute_roots(texts, threshold=0.8, links=None):
    """The class of every text by the number of its first member, from all pairs; counts links where a counter is given."""
    sets = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(texts)))
    links = collections.Counter() if links is None else links

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def brute(rows, threshold=0.8):
    """(id, class, number of linked other rows) of every row."""
    links: collections.Counter = collections.Counter()
    roots = brute_roots([t for _, t in rows], threshold, links)
    least: dict = {}
    for root, (doc, _) in zip(roots, rows, strict=True):
        if doc is not None:
            least[root] = min(least.get(root, doc), doc)
    return sorted(((doc, least.get(root), links[i]) for i, ((doc, _), root) in enumerate(zip(rows, roots, strict=True))), key=str)


def found(docs):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in nearjoin.near_duplicates(docs).collect()), key=str)


def test_bands_reach_the_recall():
    n = nearjoin.bands(0.8, 0.9999, 4)
    assert 1 - (1 - 0.8**4) ** n >= 0.9999 > 1 - (1 - 0.8**4) ** (n - 1)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd) == brute(rows)
    assert nearjoin.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("tile", [3, 768])
def test_clusters_over_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(nearjoin, "TILE", tile)
    monkeypatch.setattr(nearjoin, "BLOCK", 2 if tile == 3 else 256)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    rows = []
    for _ in range(6):
        base = word(120)
        for _ in range(12):
            edited = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 5)):
                edited[at] = f"x{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(edited)))
    rows += [(len(rows) + i, rows[0][1]) for i in range(9)] + [(100 + i, " ".join(word(80))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)


def test_documents(small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    assert found(small) == brute(rows)
    kept = nearjoin.keep_one(small)
    assert kept.columns == small.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})


def test_one_of_each_class_without_or_with_shared_ids(spark):
    rng = np.random.default_rng(3)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, 60)) for _ in range(7)]
    near = [t + " end" for t in text]
    rows = [
        (None, text[0]), (None, text[1]), (None, text[1]), (None, near[1]), (None, text[2]), (8, near[2]),  # no ids: alone, in a class, with one that has an id
        (3, text[3]), (3, text[4]), (1, near[4]), (4, text[5]), (4, text[6]), (4, text[6]), (5, near[6]), (5, near[5]),  # shared ids
        (nearjoin.NO_ID, text[0] + " " + text[6]), (None, None), (None, " "), (9, ""), (9, ""),
    ]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = nearjoin.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r.n for r in kept.collect())
    assert all(r.text == rows[r.n][1] and r.doc_id == rows[r.n][0] for r in kept.collect())
    assert sum(n in (1, 2, 3) for n in got) == 1 and sum(n in (11, 10) for n in got) == 1
    assert [n for n in got if n not in (1, 2, 3, 10, 11)] == [0, 5, 6, 8, 9, 14, 15, 16, 17, 18]


def test_sets_are_of_true_ngrams(spark):
    a, b = thue_morse(2048), thue_morse(2048, "ba")
    texts = [f"{a} {b} c d e f", f"{b} {a} c d e f", f"{a} {b}", f"{b} {a}", a, b, "one two three four five six one two three four five six", ""]
    sets = nearjoin.exact_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 1, 6, 0]
    assert all(not set(x.tolist()) & set(y.tolist()) for i, x in enumerate(sets) for y in sets[:i] if i != 1)
    assert len(set(sets[0].tolist()) & set(sets[1].tolist())) == 0
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_recall_at_the_threshold():
    """Share of pairs at 0.8 that meet in a band, by the signatures themselves."""
    rng = np.random.default_rng(11)
    met = 0
    for _ in range(600):
        grams = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        a, b = (np.unique(np.concatenate([grams[:160], x])) for x in (grams[160:], rng.integers(0, 1 << 63, 20).astype(np.uint64)))  # 160 of 200
        x, y = nearjoin.signatures([a, b], nearjoin.bands())
        met += any(p == q for p, q in zip(x, y, strict=True))
    assert met >= 599


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    df = spark.createDataFrame([(f"{a:04d}".encode(), f"{b:04d}".encode()) for a, b in edges], "a binary, b binary")
    got = {int(bytes(r.node)): int(bytes(r.root)) for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_rows_with_equal_words_and_id_tie_by_all_columns(spark):
    """Blanks and other columns differ; whatever the order of the rows, the same one stays."""
    rows = [(3, "a few  words that are long enough", 1), (3, "a few words that are long enough", 2), (3, "a few words that are long enough ", 3), (9, "a few words that are long enough", 0)]
    kept = {tuple(nearjoin.keep_one(spark.createDataFrame(order, "doc_id long, text string, n int").repartition(k)).collect()) for order in (rows, rows[::-1], rows[1:] + rows[:1]) for k in (1, 3)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1 and next(iter(kept))[0].doc_id == 3
