import os

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from strandline.llm import textkit
from tests.llm.conftest import thue_morse


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(" \n\tab\x0bé\x1c", max_size=20)), max_size=6))
def test_words_and_hashes(texts):
    raw = [t if t is None else t.encode() for t in texts]
    t = textkit.Texts(raw)
    split = [(x or b"").split() for x in raw]  # bytes.split parts at the same six bytes
    assert t.n_words.tolist() == [len(w) for w in split]
    flat = [w for ws in split for w in ws]
    assert [t.raw[a:b] for a, b in zip(t.starts, t.ends, strict=True)] == flat
    hashes = t.hashes()
    alone = [int(textkit.Texts([w]).hashes()[0]) for w in flat]
    assert hashes.tolist() == alone and len(set(alone)) == len(set(flat))
    for size in (1, 2, 5):
        found, bounds = textkit.shingles(hashes, t.words, size)
        for i, ws in enumerate(split):
            grams = [tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))] if ws else []
            mine = found[bounds[i] : bounds[i + 1]].tolist()
            assert len(mine) == len(grams) and len(set(mine)) == len(set(grams))


def test_keys_are_exact():
    words = [b"a" * n for n in range(1, 40)] + [bytes([1 + n]) * 15 for n in range(8)] + [(b"%05d" % n) * 3 for n in range(200)]
    words += [thue_morse(1 << n, letters).encode() for n in range(4, 14) for letters in ("ab", "ba")]
    data = b" ".join(words + words)
    t = textkit.Texts([data])
    low, high = t.keys()
    assert len(set(zip(low.tolist(), high.tolist(), strict=True))) == len(set(words)) == len(set(t.hashes().tolist()))
    ids = t.ids()
    assert (ids[: len(words)] == ids[len(words) :]).all() and len(set(ids.tolist())) == len(set(words))
    assert textkit.Texts([b"x"]).keys()[0][0] == ord("x")


def test_distinct_compares_whole_rows(monkeypatch):
    monkeypatch.setattr(textkit, "blend", lambda a, b: a & np.uint64(1))  # nearly all rows share the short form
    rng = np.random.default_rng(2)
    a, b, c = rng.integers(0, 5, (3, 200)).astype(np.uint64)
    first, back = textkit.distinct(a, b, c)
    rows = list(zip(a.tolist(), b.tolist(), c.tolist(), strict=True))
    assert len(first) == len(set(rows)) and [rows[first[k]] for k in back] == rows


def test_slices_and_gather():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (3, 0, 9, 1, 1)] + [None]})
    parts = list(textkit.slices([batch], limit=4))
    assert [p.num_rows for p in parts] == [2, 1, 3] and pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    values, bounds = textkit.gather(np.arange(6), np.array([0, 2, 2, 6]), np.array([2, 0, 1, 2]))
    assert values.tolist() == [2, 3, 4, 5, 0, 1, 2, 3, 4, 5] and bounds.tolist() == [0, 4, 6, 6, 10]


def test_stored_tables_are_cleared(spark):
    before = len(textkit._stored)
    df = textkit.stored(spark.range(5).toDF("i"))
    path = textkit._stored[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    assert textkit.clear_stored(spark) == before + 1 and not os.path.exists(path)
