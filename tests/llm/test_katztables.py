import collections
import functools
import math

import pytest

from strandline.llm import katz, katztables

from .test_katz import tokens


class Brute:
    """The same model from dictionaries, evaluated by recursion."""

    def __init__(self, texts, order, whole):
        self.order, self.whole = order, whole
        self.counts = [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            for h, w in self.grams(t):
                for m in range(1, order + 1):
                    self.counts[m][h[order - m :], w] += 1
        self.d = [None, *(katz.discounts([sum(n == r for n in c.values()) for r in range(1, katz.K + 2)]) for c in self.counts[1:])]
        self.after = [collections.defaultdict(dict) for _ in range(order + 1)]
        for m in range(1, order + 1):
            for (h, w), n in self.counts[m].items():
                self.after[m][h][w] = n

    def grams(self, text):
        t = tokens(text)
        p = ["<s>"] * (self.order - 1) + t
        return [(tuple(p[i : i + self.order - 1]), p[i + self.order - 1]) for i in range(len(t))]

    @functools.cache  # noqa: B019
    def seen(self, m, h):
        follow = self.after[m][h]
        size = sum(follow.values()) + (self.whole and min(follow.values()) > katz.K)
        return {w: (self.d[m][n - 1] * n if n <= katz.K else n - (0 if self.whole else 0.5)) / size for w, n in follow.items()}

    @functools.cache  # noqa: B019
    def alpha(self, m, h):
        mine = self.seen(m, h)
        return (1 - sum(mine.values())) / (1 - sum(self.p(h[1:], x) for x in mine) if m > 1 else 1)

    def p(self, h, w):
        m = len(h) + 1
        if h not in self.after[m]:
            return self.p(h[1:], w) if m > 1 else 1.0
        mine = self.seen(m, h)
        return mine[w] if w in mine else self.alpha(m, h) * (self.p(h[1:], w) if m > 1 else 1)

    def row(self, i, text):
        return i, len(tokens(text)), sum(math.log10(self.p(h, w)) for h, w in self.grams(text))


def same(train, docs, order, above):
    model = katztables.fit(train, order, above)
    brute = Brute([r.text for r in train.collect()], order, above == "whole")
    key = lambda r: (str(r[0]), r[1])
    want = sorted((brute.row(r.doc_id, r.text) for r in docs.collect()), key=key)
    got = sorted(map(tuple, katztables.score(docs, katztables.load(docs.sparkSession, model.path)).collect()), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], rel=1e-9, abs=1e-9)
    return brute


@pytest.fixture(scope="module")
def few(spark):
    """Texts with words of high counts, among them histories that only have such words."""
    rows = [(i, f"a b c a b d w{i % 7} " + "x y z " * (i % 5)) for i in range(40)] + [(40, "A b"), (40, "A b"), (None, None), (41, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("above", ["whole", "half"])
def test_other_texts(few, spark, order, above):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "new words a z x b"), (3, None), (None, ""), (4, "x y z y q")], "doc_id long, text string")
    brute = same(few, docs, order, above)
    words = [*{w for _, w in brute.counts[1]}, "never seen"]
    for h in list(brute.after[order])[:20]:  # each history's probabilities sum to one
        assert math.isclose(sum(brute.p(h, w) for w in words), 1, rel_tol=1e-9)
    if above == "whole" and order > 1:
        assert any(min(f.values()) > katz.K for f in brute.after[order].values())


def test_documents(small):
    same(small.filter("doc_id % 2 = 0"), small.filter("doc_id % 2 = 1"), 3, "whole")


def test_hot_keys_are_spread(few, monkeypatch):
    monkeypatch.setattr(katztables, "HOT", 5)
    monkeypatch.setattr(katztables, "MOST_HOT", 1_000_000)
    same(few, few, 3, "whole")


def test_order_two_with_half_counts_is_the_packed_model(small):
    learned = small.filter("crc32(cast(doc_id as string)) % 10 <> 0")
    a = sorted((r.doc_id, r.n_tokens, r.score) for r in katztables.score(small, katztables.fit(learned, 2, "half")).collect())
    b = sorted((r.doc_id, r.n_tokens, r.score) for r in katz.score_texts(small).collect())
    assert [r[:2] for r in a] == [r[:2] for r in b] and [r[2] for r in a] == pytest.approx([r[2] for r in b], rel=1e-9)


def test_odd_rows(odd, nothing):
    same(odd, odd, 3, "whole")
    model = katztables.fit(nothing, 2)
    assert [r.score for r in katztables.score(odd, model).collect()] == [0.0] * odd.count() and katztables.score(nothing, model).count() == 0
    with pytest.raises(ValueError):
        katztables.fit(odd, 0)
