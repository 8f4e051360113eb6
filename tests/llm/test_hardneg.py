"""Hard negatives against all pairs in plain Python."""

import math

import numpy as np
import pytest

from strandline.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    kept = []
    for vec, parts, label in rows:
        if vec is None or parts is None or label is None or any(x is None or not math.isfinite(x) for x in parts):
            continue
        kept.append((vec, [math.floor(256 * x) for x in parts], (label + 1) % 10 if vec % 7 == 0 else label))
    out = []
    for a, (anchor, x, label) in enumerate(kept):
        if anchor % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=False)), vec, other) for b, (vec, y, other) in enumerate(kept) if b != a]
        for ps, positive, _ in sorted(t for t in scored if t[2] == label)[:5]:
            inside = sorted(t for t in scored if t[2] != label and 50 * -ps <= 100 * -t[0] <= 95 * -ps)[:3]
            out += [(anchor, positive, rank, vec, -ps, -s) for rank, (s, vec, _) in enumerate(inside, 1)]
    return sorted(out)


def found(frame):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, hardneg.hard_negatives(frame).select(*columns).collect()))


def made(n, width, seed=0, ids=None):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.1, (10, width)) + 0.05
    label = rng.integers(0, 10, n)
    parts = centre[label] + rng.normal(0, 0.05, (n, width))
    return [(int(i), [float(x) for x in p], int(k)) for i, p, k in zip(ids if ids is not None else range(n), parts, label, strict=True)]


def test_rows_and_blocks(spark, monkeypatch):
    rows = made(400, 16)
    want = brute(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == want and len(want) > 60
    monkeypatch.setattr(hardneg, "GROUP", 3)
    monkeypatch.setattr(hardneg, "SHARDS", 2)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == want


def test_odd_rows(spark):
    rows = made(150, 6, 3)
    rows += rows[:60:3]  # repeated rows, anchors among them
    rows += [(100, rows[5][1], 3), (None, [0.1] * 6, 1), (50, None, 1), (150, [0.1] * 6, None), (200, [0.1, None, 0.2, 0.1, 0.1, 0.1], 1)]
    rows += [(250, [math.nan] * 6, 1), (300, [math.inf] + [0.0] * 5, 1), (350, [], 1), (400, [0.3, 0.2], 4), (-50, [0.2] * 6, 2), (450, [0.0] * 6, 3)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", block int, score int")
    assert found(frame) == brute(rows)
    assert found(frame.limit(0)) == []
    assert found(frame.filter("vec_id = 50")) == []


def test_ties_and_copies(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(120)] + [(i, [0.4, 0.25], (i + 1) % 3) for i in range(120, 260)]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want and len(want) > 20


@pytest.mark.parametrize("size", [1, 40, 3000, 1 << 22, 1 << 28])
def test_products_are_exact(size):
    """Fields of doubles where they fit, else of Python integers."""
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (9, 50)), rng.integers(-size, size + 1, (23, 50))
    a[0], b[0], b[1] = size, size, -size  # the largest sums
    want = [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a]
    assert hardneg.products(a, b, -size, size).tolist() == want


def test_embeddings_of_the_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    want = brute(rows)
    assert found(frame) == want and len(want) > 50
