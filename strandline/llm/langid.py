"""Language identification by averaged hashed subword embeddings with a linear softmax.

Features are the byte n-grams (2 to 4 bytes; A-Z lower-cased, bytes beyond ASCII as they are, any other byte a blank) of
the whole text, hashed into ``buckets`` rows of an embedding table.  The text's vector is the average of
their embeddings; a linear softmax over it gives the languages.  Both tables are trained together by
stochastic gradient descent in NumPy.  A temperature, fitted on a part of the sample that training does
not see, calibrates the scores; a text whose calibrated score is below the rejection bound (a low
quantile of that part's right answers) is not ``accepted``.

Training takes at most ``max_train`` documents (those with the least hash of their id), which bounds
what reaches the driver: per document one sparse row of at most ``buckets`` counts.

For prediction the product of the two tables is taken first, so a text costs one sum over rows of
length (number of languages); n-grams are looked up ``PIECE`` at a time.  A text of more than ``LONG`` bytes is counted by
buckets piece by piece, and needs little memory beyond its own bytes.

Edge cases: a null text or one without a letter is ``und`` with score 0 and is not accepted; documents
with a null lang, text or id teach nothing; a repeated id teaches once; with nothing to learn from (an empty table),
every prediction is ``und``; repeated rows get equal answers; ties go to the first language in order of name; any length
is read whole; other columns are ignored.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import as_bytes, slices

#: Bytes as features see them: lower-case letters and bytes of other alphabets; the rest is blank.
FOLD = np.full(256, 32, dtype=np.uint32)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)
SIZES = (2, 3, 4)
#: Part of the sample that calibrates, and quantile of its right answers that sets the rejection bound.
CALIBRATE, REJECT_QUANTILE, MOST_BOUND = 0.2, 0.002, 0.5
#: N-grams whose rows of the table are held at once.
PIECE = 1 << 18
#: Texts of more bytes are counted in pieces.
LONG = 1 << 20
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def grams(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every text, and the bounds by text."""
    parts = [t or b"" for t in texts]
    raw = np.frombuffer(b"\n" + b"\n".join([*parts, b""]), dtype=np.uint8)
    size = np.fromiter((len(t) for t in parts), dtype=np.int64, count=len(parts))
    begin = np.append(0, np.cumsum(size + 1))[:-1]  # of the blank before each text
    folded = FOLD[raw]
    found = []
    for n in SIZES:
        if len(folded) < n:
            continue
        found.append(_buckets(folded, n, bits))
    counts = [np.maximum(size + 2 - n + 1, 0) for n in SIZES]
    bounds = np.append(0, np.cumsum(sum(counts)))
    out = np.empty(bounds[-1], dtype=np.int32)
    at = bounds[:-1].copy()
    for code, count in zip(found, counts, strict=False):
        total = np.append(0, np.cumsum(count))
        steps = np.arange(total[-1])
        out[steps + np.repeat(at - total[:-1], count)] = code[steps + np.repeat(begin - total[:-1], count)]
        at += count
    return out, bounds


def _buckets(folded: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram from each place."""
    code = folded[: len(folded) - n + 1].copy()
    for k in range(1, n):
        code |= folded[k : len(folded) - n + 1 + k] << np.uint32(8 * k)
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return (code >> np.uint32(32 - bits)).astype(np.int32)


def gram_counts(text: bytes, bits: int) -> np.ndarray:
    """How often a text has each bucket, from pieces of ``PIECE`` bytes that overlap by one n-gram less a byte."""
    counts = np.zeros(1 << bits, dtype=np.int64)
    raw = np.frombuffer(text, dtype=np.uint8)
    for at in range(-1, len(raw) + 1, PIECE):  # from the blank before the text to the one after it
        piece = np.full(min(PIECE + max(SIZES) - 1, len(raw) + 1 - at), 32, dtype=np.uint32)
        inside = FOLD[raw[max(at, 0) : at + len(piece)]]
        piece[max(-at, 0) : max(-at, 0) + len(inside)] = inside
        for n in SIZES:
            own = piece[: PIECE + n - 1]
            if len(own) >= n:
                counts += np.bincount(_buckets(own, n, bits), minlength=1 << bits)
    return counts


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if ASCII_LETTER.search(text):
        return True
    if text.isascii():
        return False
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return any(c.isalpha() for at in range(0, len(text), PIECE) for c in decoder.decode(text[at : at + PIECE]))


@dataclass
class LanguageModel:
    languages: list[str]
    bits: int
    table: np.ndarray  #: embedding table times softmax weights, divided by the temperature
    bias: np.ndarray
    bound: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Calibrated probabilities by text and language."""
        k = len(self.languages)
        long = [i for i, t in enumerate(texts) if t and len(t) > LONG]
        found, bounds = grams([None if t and len(t) > LONG else t for t in texts] if long else texts, self.bits)
        logits = np.tile(self.bias, (len(texts), 1))
        n = np.diff(bounds)
        owner = np.repeat(np.arange(len(texts)), n)
        for i in range(0, len(found), PIECE):
            rows, own = self.table[found[i : i + PIECE]], owner[i : i + PIECE]
            first = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
            logits[own[first]] += np.add.reduceat(rows, first, axis=0) / n[own[first], None]
        for i in long:
            counts = gram_counts(texts[i], self.bits)
            logits[i] = self.bias + counts @ self.table / counts.sum()
        return _softmax(logits) if k else logits


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], bits: int, dim: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 5) -> LanguageModel:
    """rows: (buckets, shares, language); SGD on the cross-entropy."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    if not rows:
        return LanguageModel([], bits, np.zeros((1 << bits, 0)), np.zeros(0), 0.0)
    held = rng.random(len(rows)) < CALIBRATE if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
    embed = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    weight, bias = rng.uniform(-0.1, 0.1, (dim, k)), np.zeros(k)
    fit = [r for r, h in zip(rows, held, strict=True) if not h]
    total, step = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            at, share, label = fit[i]
            x = share @ embed[at]
            p = _softmax((x @ weight + bias)[None])[0]
            p[label] -= 1
            now = rate * (1 - step / total)
            back = weight @ p
            weight -= now * np.outer(x, p)
            bias -= now * 0.1 * p
            embed[at] -= (now * 20) * share[:, None] * back
            step += 1
    table = embed @ weight
    check = [r for r, h in zip(rows, held, strict=True) if h] or fit
    logits = np.array([share @ table[at] + bias for at, share, _ in check]).reshape(-1, k)
    label = np.array([r[2] for r in check], dtype=int)
    best, heat = np.inf, 1.0
    for t in np.geomspace(0.2, 20, 60):  # the temperature with the least loss on the calibration part
        loss = -np.log(np.maximum(_softmax(logits / t)[np.arange(len(label)), label], 1e-300)).mean()
        if loss < best - 1e-12:
            best, heat = loss, t
    p = _softmax(logits / heat)
    right = p[np.arange(len(label)), label][p.argmax(axis=1) == label] if len(label) else np.zeros(0)
    bound = float(min(MOST_BOUND, np.quantile(right, REJECT_QUANTILE))) if len(right) else 0.0
    return LanguageModel(languages, bits, table / heat, bias / heat, bound)


def fit(docs: DataFrame, max_train: int = 1500, bits: int = 15, key: str = "doc_id") -> LanguageModel:
    """Learn from at most max_train rows of docs (doc_id, text, lang) with a lang and a text."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = known.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(F.lit(11), key), key).limit(max_train)
    sample = known.join(F.broadcast(picked), key).select(F.col(key).cast("bigint").alias("doc_id"), "text", "lang")

    def run(batches):
        for b in slices(batches, limit=1 << 20):
            found, bounds = grams(as_bytes(b.column("text")), bits)
            at, share = [], []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                where, n = np.unique(found[i:j], return_counts=True)
                at.append(where.astype("<i4").tobytes())
                share.append((n / max(1, j - i)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["doc_id", "lang", "at", "share"])

    counted = sample.mapInArrow(run, "doc_id long, lang string, at binary, share binary")
    counted = counted.groupBy("doc_id").agg(F.min(F.struct("at", "share", "lang")).alias("r")).select("doc_id", "r.*")  # repeated ids count once
    got = sorted(counted.collect(), key=lambda r: r.doc_id)
    languages = sorted({r.lang for r in got})
    rows = [(np.frombuffer(r.at, dtype="<i4"), np.frombuffer(r.share, dtype="<f4").astype(float), languages.index(r.lang)) for r in got]
    return train(rows, languages, bits)


def answers(model: LanguageModel, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and acceptance of every text."""
    letters = np.array([has_letter(t) for t in texts], dtype=bool)
    if not model.languages or not texts:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    p = model.scores(texts)
    best = p.argmax(axis=1)
    score = np.where(letters, np.round(p[np.arange(len(best)), best], 6), 0.0)
    names = [model.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
    return names, score, letters & (score >= model.bound)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits rows of one number a language: fixed size
    limit = (4 << 20) // max(1, len(model.languages)) + 1

    def run(batches):
        for b in slices(batches, limit=limit):
            names, score, accepted = answers(shared.value, as_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def keep_rows(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows whose language is accepted, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit = (4 << 20) // max(1, len(model.languages)) + 1

    def run(batches):
        for b in slices(batches, limit=limit):
            yield b.filter(pa.array(answers(shared.value, as_bytes(b.column("text")))[2], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(modulus: int, key: str = "doc_id"):
    """crc32 of the id as text, modulo (a null id counts as the text "null")."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), F.lit(modulus))


def language_of(docs: DataFrame, max_train: int = 1500) -> DataFrame:
    """Predictions for all rows by a model that learns from those whose remainder modulo 5 is not 0."""
    model = fit(docs.filter(remainder(5) != 0), max_train)
    return predict(docs, model).withColumn("held_out", remainder(5) == 0).select("doc_id", "held_out", "lang_pred", "score", "accepted")
