import collections
import math
import re

import numpy as np
import pytest

from strandline.llm import katz


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class Brute:
    """The same model from dictionaries."""

    def __init__(self, rows):
        learned = [tokens(t) for i, t in rows if not katz.held_out(i, 10)]
        self.one = collections.Counter(w for d in learned for w in d)
        self.two = collections.Counter(p for d in learned for p in zip(["<s>", *d], d, strict=False))
        self.before = collections.Counter()
        self.next = collections.defaultdict(set)
        for (h, w), n in self.two.items():
            self.before[h] += n
            self.next[h].add(w)
        self.n, self.v = sum(self.one.values()), len(self.one)
        of = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]
        self.d1, self.d2 = katz.discounts(of(self.one)), katz.discounts(of(self.two))
        cut = lambda d, c: d[c - 1] * c if c <= katz.K else c - 0.5
        self.p1 = {w: cut(self.d1, c) / self.n for w, c in self.one.items()}
        self.unknown = 1 - sum(self.p1.values())
        self.p2 = {p: cut(self.d2, c) / self.before[p[0]] for p, c in self.two.items()}

    def p(self, h, w):
        lower = self.p1.get(w, self.unknown)
        if h not in self.before:
            return lower
        if (h, w) in self.p2:
            return self.p2[h, w]
        follow = self.next[h]
        return (1 - sum(self.p2[h, x] for x in follow)) / (1 - sum(self.p1[x] for x in follow)) * lower

    def row(self, i, text):
        t = tokens(text)
        base = sum(math.log10((self.one[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t)
        score = sum(math.log10(self.p(h, w)) for h, w in zip(["<s>", *t], t, strict=False))
        return i, katz.held_out(i, 10), len(t), sum(self.one[w] > 0 for w in t), self.n, base, score


def same(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = Brute(rows)
    want = sorted((model.row(i, t) for i, t in rows), key=lambda r: (str(r[0]), r[2]))
    got = sorted(map(tuple, katz.score_texts(docs).collect()), key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)
    return model


def test_documents(small):
    model = same(small)
    words = [*model.one, "never seen"]
    for h in ("<s>", words[0], words[5], "the", "never seen"):  # each history's probabilities sum to one
        assert math.isclose(sum(model.p(h, w) for w in words), 1, rel_tol=1e-9)


def test_odd_rows(odd, nothing):
    same(odd)
    assert katz.score_texts(nothing).count() == 0


def test_no_training_rows(spark):
    held = [i for i in range(200) if katz.held_out(i, 10)][:3]
    got = katz.score_texts(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert [(r.train_tokens, r.n_known, r.score) for r in got] == [(0, 0, 0.0)] * 3 and all(abs(r.base_score) < 1e-9 for r in got)


@pytest.mark.parametrize("gather", [40, 3_000_000])
def test_many_blocks_and_a_frequent_word(spark, monkeypatch, gather):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("hot" if rng.random() < 0.4 else f"w{int(rng.zipf(1.5)) % 50}" for _ in range(int(rng.integers(0, 60))))) for i in range(300)]
    monkeypatch.setattr(katz, "GATHER", gather)
    same(spark.createDataFrame(rows, "doc_id long, text string"))


def test_a_flush_with_very_many_words(small, monkeypatch):
    monkeypatch.setattr(katz, "MOST_WORDS", 10)
    monkeypatch.setattr(katz, "SHARE", 500)  # many shares to a partition
    same(small)
