"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features; the probability that one document is
preferred to another is the logistic function of the difference of their strengths.  The preference
pairs (a document labelled good before one labelled bad, both drawn at random with a fixed seed) come from a
bounded sample of labelled rows (``max_train`` rows, ``pairs`` pairs), and the weights minimise the logistic loss on the
differences of the features by Newton steps with a ridge.  The threshold is a quantile of the sample's strengths: the one
that leaves below it the share of bad documents which best separates the labels.  Scores are logistic in
the strength, placed so that the threshold has ``CUT``, with a slope fitted to the labels.

Features (of the whole text): lengths, shares of symbols, digits, capitals, punctuation, bars and other bytes, lines, repeated
lines, words and word runs, and short or long words, each also squared; and the content, one number.  The content is a
Bradley-Terry strength of its own, linear in the shares of hashed words and of hashed character n-grams; in training, a document's
content comes from a model of the other half of the sample, so that it says what content says of documents not seen; others get
the mean of both.  Half of the
pairs join documents of similar length, so that length does not stand for quality alone.

Edge cases: null and empty texts have the features of an empty text and get a score like any other; documents that repeat
get equal scores, and of those that share an id one teaches; labels that are null or name no document teach nothing; rows of
labels that repeat count once, and of two labels of one id the better counts; with one
class only, or none, all strengths are 0 and every score is ``CUT``; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .langid import grams, remainder
from .textkit import U64, Texts, as_bytes, mix, shingles, slices, span_hashes

#: Score of a document at the threshold.
CUT = 0.3
#: Places in the order of length from which a pair's other document comes; step of the gradients.
NEAR, STEP = 20, 4.0
CLASSES = {
    "capital": range(65, 91),
    "digit": range(48, 58),
    "other_byte": range(128, 256),
    "stop": b".,;:",
    "bang": b"!?",
    "bar": b"|<>{}[]\\=+~^",
    "symbol": b"#*$%&@_/",
    "newline": b"\n",
}
NAMES = ["words", "log_words", "word_length", "short", "long", "repeat_words", "repeat_pairs", "repeat_eights", "repeat_lines", "common_word", *CLASSES, "capital_words", "single_words"]
#: Bits of the hashes of words and of character n-grams.
BITS = 11
#: Dimensions of the content.
BUCKETS = 2 << BITS


def _repeats(keys: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """By text: share of keys that repeat an earlier one, and share of the most common key."""
    folded = mix(keys + (owner.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F))
    _, first, n = np.unique(folded, return_index=True, return_counts=True)
    total = np.maximum(np.bincount(owner, minlength=count), 1)
    most = np.zeros(count)
    np.maximum.at(most, owner[first], n)
    return 1 - np.bincount(owner[first], minlength=count) / total - (np.bincount(owner, minlength=count) == 0), most / total


def features(texts: list[bytes | None]) -> np.ndarray:
    t = Texts(texts)
    owner, words = t.owner(), t.hashes()
    n, size = np.maximum(t.n_words, 1), np.maximum(t.end - t.begin, 1)
    length = t.ends - t.starts
    by = lambda v: np.bincount(owner, v, minlength=t.count)
    out = {"words": np.minimum(t.n_words, 200) / 200, "log_words": np.log1p(t.n_words), "word_length": by(length) / n / 10}
    out |= {"short": by(length <= 2) / n, "long": by(length >= 12) / n}
    out["repeat_words"], out["common_word"] = _repeats(words, owner, t.count)
    for name, k in (("repeat_pairs", 2), ("repeat_eights", 8)):
        runs, bounds = shingles(words, t.words, k)
        out[name], _ = _repeats(runs, np.repeat(np.arange(t.count), np.diff(bounds)), t.count)
    stops = np.flatnonzero(t.bytes == 10)
    begins = np.append(0, stops[:-1] + 1) if len(stops) else stops
    full = stops > begins
    out["repeat_lines"], _ = _repeats(span_hashes(t.raw, begins[full], stops[full]), np.searchsorted(t.end, begins[full]), t.count)
    bounds = np.append(t.begin, len(t.bytes))
    for name, members in CLASSES.items():
        flag = np.zeros(256, dtype=bool)
        flag[list(members)] = True
        total = np.append(0, np.cumsum(flag[t.bytes], dtype=np.int64))
        out[name] = (total[bounds[1:]] - total[bounds[:-1]] - (name == "newline")) / size
    if len(t.starts):
        capital = (t.bytes >= 65) & (t.bytes <= 90)
        first, second = capital[t.starts], capital[np.minimum(t.starts + 1, len(t.bytes) - 1)] & (length > 1)
        out["capital_words"] = by(first & second) / n
    else:
        out["capital_words"] = np.zeros(t.count)
    out["single_words"] = by(length == 1) / n
    return np.stack([out[name] for name in NAMES], axis=1)


def hashed(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words and of the character n-grams of the texts, each with the bounds by text."""
    t = Texts(texts, lower=True)
    found, bounds = grams(texts, BITS)
    return [((t.hashes() >> U64(64 - BITS)).astype(np.int64), t.words), (found + (1 << BITS), bounds)]


def shares(texts: list[bytes | None]) -> np.ndarray:
    """By text the share of each bucket among its words, and among its n-grams."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for found, bounds in hashed(texts):
        n = np.diff(bounds)
        owner = np.repeat(np.arange(len(texts)), n)
        counts = np.bincount(owner * BUCKETS + found, minlength=out.size).reshape(out.shape)
        out += (counts / np.maximum(n, 1)[:, None]).astype(np.float32)
    return out


def content(texts: list[bytes | None], weight: np.ndarray) -> np.ndarray:
    """The strength of the texts' content: the mean weight of their words plus that of their n-grams."""
    out = np.zeros(len(texts))
    for found, bounds in hashed(texts):
        total = np.append(0.0, np.cumsum(weight[found]))
        out += (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
    return out


def pairs_of(label: np.ndarray, words: np.ndarray, pairs: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Good and bad documents to compare; in half of the pairs the bad one is among the nearest in length."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    bad = bad[np.argsort(words[bad], kind="stable")]
    half = pairs // 2
    near = np.searchsorted(words[bad], words[a[:half]]) + rng.integers(-NEAR, NEAR + 1, half)
    b[:half] = bad[np.clip(near, 0, len(bad) - 1)]
    return a, b


def train_content(x: np.ndarray, label: np.ndarray, words: np.ndarray, pairs: int, seed: int, ridge: float = 2e-4, rounds: int = 120) -> np.ndarray:
    """Weights of the buckets from preference pairs, by accelerated gradient steps; zeros with one class only."""
    if len(set(label.tolist()) & {0, 1}) < 2:
        return np.zeros(BUCKETS)
    a, b = pairs_of(label, words, pairs, np.random.default_rng(seed))
    scale = 1 / np.sqrt(x.mean(axis=0, dtype=np.float64) + 1e-5)
    w = past = np.zeros(BUCKETS)
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - past)
        s = x @ (ahead * scale).astype(np.float32)
        p = 1 / (1 + np.exp(np.clip(s[a] - s[b], -50, 50)))  # of the wrong order
        push = np.bincount(a, p, minlength=len(x)) - np.bincount(b, p, minlength=len(x))
        past, w = w, ahead + STEP * ((push.astype(np.float32) @ x) * scale / pairs - ridge * ahead)
    return np.round(w * scale, 6)


@dataclass
class Ranking:
    weights: np.ndarray  #: of the buckets
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(np.concatenate([z, z * z], axis=1), -30, 30) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def train(x: np.ndarray, label: np.ndarray, buckets: np.ndarray | None = None, pairs: int = 40_000, ridge: float = 3.0, seed: int = 9) -> Ranking:
    """Weights from preference pairs; the threshold as a quantile of the strengths.

    x: features of the documents, buckets: their shares of the buckets (none: the content is 0).
    """
    words = x[:, NAMES.index("log_words")] if len(x) else np.zeros(0)
    weights, told = np.zeros(BUCKETS), np.zeros(len(x))
    if buckets is not None and len(x):
        half = np.random.default_rng(seed).permutation(len(x)) % 2 == 0
        for own, other in ((half, ~half), (~half, half)):
            one = train_content(buckets[other], label[other], words[other], pairs, seed)
            told[own] = buckets[own] @ one
            weights += one / 2
    x = np.concatenate([x.reshape(len(x), len(NAMES)), told[:, None]], axis=1)
    size = len(NAMES) + 1
    mean = x.mean(axis=0) if len(x) else np.zeros(size)
    scale = x.std(axis=0) + 1e-6 if len(x) else np.ones(size)
    model = Ranking(weights, mean, scale, np.zeros(2 * size), 0.0, 1.0)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return model
    z = (x - mean) / scale
    z = np.clip(np.concatenate([z, z * z], axis=1), -30, 30)
    a, b = pairs_of(label, words, pairs, np.random.default_rng(seed))
    d = z[a] - z[b]
    w = np.zeros(d.shape[1])
    for _ in range(60):  # Newton steps on the mean loss of the pairs
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # of the wrong order
        gradient = -(d * p[:, None]).mean(axis=0) + ridge / pairs * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + (ridge / pairs + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    model.weight = w
    s = z @ w
    order = np.argsort(s, kind="stable")
    below = np.cumsum(label[order] == 0) - np.cumsum(label[order] == 1)  # right less wrong decisions, by place
    place = int(below.argmax())
    # the quantile between that place and the next
    model.threshold = float(s[order[place : place + 2]].mean()) if below[place] > 0 else float(s.min()) - 1.0
    margin = s - model.threshold
    best = np.inf
    for slope in np.geomspace(0.05, 5, 40):
        q = 1 / (1 + np.exp(-np.clip(slope * margin + np.log(CUT / (1 - CUT)), -700, 700)))
        loss = -np.mean(np.where(label == 1, np.log(q + 1e-12), np.log(1 - q + 1e-12)))
        if loss < best:
            best, model.slope = loss, float(slope)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000) -> Ranking:
    """Learn from at most max_train labelled rows (those with the least hash of their doc_id)."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(max_train)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches):
        for b in slices(batches):
            texts = as_bytes(b.column("text"))
            for k in range(0, len(texts), 256):
                some = texts[k : k + 256]
                rows = [r.astype("<f8").tobytes() for r in features(some)]
                lists = [(np.flatnonzero(r).astype("<u2"), r) for r in shares(some)]
                packed = [i.tobytes() + r[i].astype("<f4").tobytes() for i, r in lists]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(k, 256), b.column("quality").slice(k, 256), pa.array(rows, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "quality", "x", "s"])

    got = rows.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x binary, s binary")
    got = got.groupBy("doc_id").agg(F.min(F.struct("x", "s", "quality")).alias("r")).select("doc_id", "r.*").collect()  # max_train rows of a fixed size
    got = sorted(got, key=lambda r: r.doc_id)
    x = np.array([np.frombuffer(r.x, "<f8") for r in got]).reshape(-1, len(NAMES))
    buckets = np.zeros((len(got), BUCKETS), dtype=np.float32)
    for k, r in enumerate(got):
        n = len(r.s) // 6
        buckets[k, np.frombuffer(r.s, "<u2", n)] = np.frombuffer(r.s, "<f4", n, 2 * n)
    return train(x, np.array([r.quality for r in got], dtype=int), buckets)


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def run(batches):
        for b in slices(batches):
            texts = as_bytes(b.column("text"))
            s = model.score(np.concatenate([features(texts), content(texts, model.weights)[:, None]], axis=1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def quality_of(docs: DataFrame, labels: DataFrame, max_train: int = 6000) -> DataFrame:
    """Scores of all rows by a model that learns labels only from rows whose remainder modulo 5 is not 0."""
    model = fit(docs, labels.filter(remainder(5) != 0), max_train)
    return score(docs, model).withColumn("held_out", remainder(5) == 0).select("doc_id", "held_out", "score", "predicted")
