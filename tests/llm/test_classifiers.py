import math
import os
import re
import subprocess
import sys
import textwrap
import zlib

import duckdb
import numpy as np
import pytest

from strandline.llm import langid, licenses, ranking
from tests.llm.conftest import SF


def test_licence_lines(spark):
    m = licenses.fitted()
    texts = licenses.licence_texts()
    after = lambda f: "" if f == "all-rights-reserved" else " and some after it"
    rows = [(i, f"some words first\n{t}{after(f)}") for i, (f, ts) in enumerate(texts.items()) for t in ts]
    want = dict(enumerate(texts))
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), m).collect():
        assert (r.license, r.n_paragraphs) == (want[r.doc_id], 1) and r.similarity >= licenses.CONFIRM
    rows = [(0, "Licensed under the Eclipse Public License, version 1.0."), (1, "the gnu is an antelope"), (2, "ein Satz mit Wörtern"), (3, "Released under the Zlib License."), (4, "renew a license before the trip")]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    assert got == {0: "unknown", 1: "none", 2: "none", 3: "unknown", 4: "none"}


def test_the_fitted_model_is_the_trained_one():
    """Up to the last bits, which depend on the machine."""
    a, b = licenses.train(), licenses.fitted()
    assert a.classes == b.classes and a.templates == [(f, t) for f, t in b.templates] and a.bound == b.bound
    assert len(set(a.weights) ^ set(b.weights)) <= 3
    assert all(np.allclose(a.weights[g], w, atol=1e-3) for g, w in b.weights.items() if g in a.weights) and np.allclose(a.bias, b.bias, atol=1e-3)


def test_threads_do_not_change_the_sql():
    told = [
        subprocess.run([sys.executable, "-c", "import hashlib; from strandline.llm import licenses; print(hashlib.sha256(licenses.scan_sql().encode()).hexdigest())"], env=os.environ | {"OPENBLAS_NUM_THREADS": n}, capture_output=True, text=True, check=True).stdout
        for n in ("1", "8")
    ]
    assert told[0] == told[1] and len(told[0].strip()) == 64


def test_bodies_of_licences(spark):
    """Wordings and sentences that are not in the training lists."""
    rows = [
        (0, "Anyone is free to copy, modify, publish, use, compile, sell or distribute this program, in source code form\nor as a compiled binary, for any purpose, commercial or not, and by any means.", "unlicense"),
        (1, "THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND\nANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE\nARE DISCLAIMED.", "bsd"),
        (2, "The data set is released under CC0.", "cc0-1.0"), (3, "The examples are distributed under MIT license terms.", "mit"),
        (4, "anyone is free to walk in the park", "none"), (5, "he is free to copy the text for any purpose", "none"),
    ]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    assert {i: got[i] for i, _, w in rows} == {i: w for i, _, w in rows}


def test_every_licence_text_has_an_anchor():
    assert all(re.search(licenses.ANCHOR_PATTERN, t) for ts in licenses.licence_texts().values() for t in ts)


def brute_licence(text, m):
    """All blocks and lines in plain Python; no text is left out beforehand, only the features of paragraphs without an anchor."""
    none = m.classes[-1]

    def judge(x):
        found = licenses.grams(licenses.words(x)) if re.search(licenses.ANCHOR_PATTERN, x) else []
        z = np.array(m.bias) + sum((np.array(m.weights[g]) for g in found if g in m.weights), np.zeros(len(m.bias)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        name, score = m.classes[int(p.argmax())], round(float(p.max()), licenses.DIGITS)
        if name == none and (score >= licenses.NONE_BOUND or not found):
            return None
        pairs = set(licenses.grams(licenses.words(x), (2,)))
        similarity = max([round(sum(v for g, v in t.items() if g in pairs), licenses.DIGITS) for f, t in m.templates if f == name], default=0)
        firm = score >= m.bound and similarity >= licenses.CONFIRM
        return firm, firm and name not in licenses.GENERIC, score, name, similarity

    chosen = []
    for block in re.split(licenses.BLANK_LINES, re.sub(licenses.COMMENT, "", text or "")):
        lines = [j for j in map(judge, block.split("\n")) if j]
        whole = judge(block.replace("\n", " ")) if "\n" in block else None
        closest = max((x[4] for x in lines if x[0]), default=-1)
        if whole and (not lines or whole[0] and whole[4] > closest or whole[1] and not any(x[1] for x in lines)):
            lines = [whole]
        chosen += lines
    best = max(chosen, key=lambda j: j[:3], default=None)
    return ("none" if best is None else best[3] if best[0] else "unknown"), len(chosen)


def test_licences_of_documents(small, odd, nothing):
    m = licenses.fitted()
    for docs in (small, odd):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = sorted(((r.doc_id, (r.license, r.n_paragraphs)) for r in licenses.scan(docs).collect()), key=str)
        assert got == sorted(((i, brute_licence(t, m)) for i, t in rows), key=str)
    assert licenses.scan(nothing).count() == 0


def test_licence_sql(small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.sql(licenses.scan_sql()).fetchall()) == sorted(map(tuple, licenses.scan(small).collect()))


def test_the_scan_is_native(small):
    plan = licenses.scan(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_ranking_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in ranking.quality_of(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    pairs = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in pairs]) >= 0.93


def test_ranking_of_odd_rows(spark, odd, nothing):
    few = spark.createDataFrame([(4, 1), (4, 1), (8, 0), (10, None), (77, 1)], "doc_id long, quality int")
    for labels in (few, few.limit(0), few.filter("quality = 1")):
        rows = ranking.quality_of(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in ranking.quality_of(odd, few.limit(0)).collect()}
    assert len(same) == 1 and abs(same.pop() - ranking.CUT) < 1e-9
    assert ranking.quality_of(nothing, few).count() == 0


def test_pairs_order_strengths():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(ranking.NAMES)))
    label = (x[:, 3] + 0.3 * rng.normal(size=600) > -0.8).astype(int)
    m = ranking.train(x, label)
    s = m.score(np.concatenate([x, np.zeros((600, 1))], axis=1))
    assert np.mean((s >= ranking.CUT) == label) > 0.9
    assert s[label == 1].mean() > s[label == 0].mean() + 0.5


def test_content_orders_documents_that_counts_cannot_tell():
    """Equal lengths and shapes; only the words differ, and those of held-out documents are the same in other orders."""
    rng = np.random.default_rng(4)
    fine, poor = ([f"{c}{x:02d}" for x in range(40)] for c in "qv")
    make = lambda good: " ".join(rng.choice(fine if good else poor, 12).tolist() + rng.choice([f"n{x:02d}" for x in range(60)], 48).tolist()).encode()
    label = np.arange(500) % 2
    texts = [make(k) for k in label]
    x, buckets = ranking.features(texts), ranking.shares(texts)
    m = ranking.train(x[:300], label[:300], buckets[:300])
    told = ranking.content(texts, m.weights)
    assert np.allclose(told, buckets @ m.weights, atol=1e-4)
    s = m.score(np.concatenate([x, told[:, None]], axis=1))
    assert np.mean((s[300:] >= ranking.CUT) == label[300:]) > 0.95
    assert m.weights.tolist() == ranking.train(x[:300], label[:300], buckets[:300]).weights.tolist()


def test_pairs_of_similar_length():
    rng = np.random.default_rng(7)
    label, words = np.arange(4000) % 2, rng.uniform(0, 9, 4000)
    a, b = ranking.pairs_of(label, words, 1000, rng)
    assert set(label[a]) == {1} and set(label[b]) == {0}
    assert np.abs(words[a[:500]] - words[b[:500]]).max() < 0.3 < np.abs(words[a[500:]] - words[b[500:]]).mean()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    got = {r.doc_id: r for r in langid.language_of(docs, 400).collect()}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.97


def test_language_of_odd_rows(odd, nothing):
    model = langid.fit(odd)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, model).collect()), key=str)
    letters = {(i, any(c.isalpha() for c in t or "")) for i, t in ((r.doc_id, r.text) for r in odd.collect())}
    assert {(i, lang != "und") for i, lang, _ in got} == letters and all(0 <= s <= 1 for _, _, s in got)
    empty = langid.fit(nothing)
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0
    assert langid.keep_rows(odd, model).columns == odd.columns


@pytest.mark.parametrize("size", [1, 3, 50])
def test_language_scores_do_not_depend_on_the_batch(size):
    texts = ["Ein Satz über nichts".encode(), b"", None, b"a", b"the words of this text", "déjà vu là-bas".encode()] * 9
    one = [langid.grams([t], 12) for t in texts]
    for i in range(0, len(texts), size):
        found, bounds = langid.grams(texts[i : i + size], 12)
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            assert found[a:b].tolist() == one[i + k][0].tolist()


def chr_byte(c):
    return bytes([c])


def plain_features(text):
    """The features of one text, by name."""
    text = text or ""
    raw = text.encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = max(1, len(w)), max(1, len(raw))
    repeated = lambda items: 1 - len(set(items)) / len(items) if items else 0.0
    runs = lambda k: [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    lines = [x for x in raw.split(b"\n") if x]
    out = {"words": min(len(w), 200) / 200, "log_words": np.log1p(len(w)), "word_length": sum(map(len, w)) / n / 10, "short": sum(len(x) <= 2 for x in w) / n, "long": sum(len(x) >= 12 for x in w) / n}
    out |= {"repeat_words": repeated(w), "repeat_pairs": repeated(runs(2)), "repeat_eights": repeated(runs(8)), "repeat_lines": repeated(lines), "common_word": max((w.count(x) for x in set(w)), default=0) / n}
    out |= {name: sum(map(raw.count, map(chr_byte, members))) / size for name, members in ranking.CLASSES.items()}
    big = lambda x: len(x) > 1 and x[:1].isupper() and x[1:2].isupper()
    return out | {"capital_words": sum(map(big, w)) / n, "single_words": sum(len(x) == 1 for x in w) / n}


def test_features_and_scores_against_plain_python(spark, small, odd):
    texts = [r.text for r in small.limit(60).collect()] + [r.text for r in odd.collect()]
    want = np.array([[plain_features(t)[name] for name in ranking.NAMES] for t in texts])
    got = ranking.features([t if t is None else t.encode() for t in texts])
    np.testing.assert_allclose(got, want, atol=1e-12)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = ranking.fit(small, labels)
    # what was learnt: the minimum of the pairs' logistic loss with a ridge, found again from the same pairs
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    rows = sorted((r.doc_id, r.text) for r in small.collect() if r.doc_id in known)
    x = np.array([[plain_features(t)[name] for name in ranking.NAMES] for _, t in rows])
    y = np.array([known[i] for i, _ in rows])
    # the content of each half from a model of the other; then of all, word by word and n-gram by n-gram, from the mean of both
    length, buckets = x[:, ranking.NAMES.index("log_words")], ranking.shares([t and t.encode() for _, t in rows])
    half = np.random.default_rng(9).permutation(len(x)) % 2 == 0
    parts = {k: ranking.train_content(buckets[half == k], y[half == k], length[half == k], 40_000, 9) for k in (True, False)}
    assert np.allclose(model.weights, (parts[True] + parts[False]) / 2)
    told = np.array([float(buckets[i] @ parts[not half[i]]) for i in range(len(x))])
    mean_of = lambda found: sum(model.weights[found]) / max(1, len(found))
    words = [ranking.hashed([t and t.encode()])[0][0] for _, t in rows]
    full = [mean_of(w) + mean_of([(1 << ranking.BITS) + g for g in plain_grams(t and t.encode(), ranking.BITS)]) for w, (_, t) in zip(words, rows, strict=True)]
    final = np.concatenate([x, np.array(full)[:, None]], axis=1)
    x = np.concatenate([x, told[:, None]], axis=1)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    z = np.clip(np.concatenate([z, z * z], axis=1), -30, 30)
    a, b = ranking.pairs_of(y, length, 40_000, np.random.default_rng(9))
    d = z[a] - z[b]

    def loss(w):
        return np.log1p(np.exp(-d @ w)).mean() + 3.0 / 40_000 * (w @ w) / 2

    best = loss(model.weight)
    for k in range(len(model.weight)):
        for step in (1e-2, -1e-2):
            w = model.weight.copy()
            w[k] += step
            assert loss(w) >= best - 1e-7
    of = lambda rows_: [float(sum(w * min(30, max(-30, v)) for w, v in zip(model.weight, [*u, *(q * q for q in u)], strict=True))) for u in (rows_ - model.mean) / model.scale]
    strength, learnt = of(final), of(x)
    wanted = {i: 1 / (1 + math.exp(-(model.slope * (s - model.threshold) + math.log(0.3 / 0.7)))) for (i, _), s in zip(rows, strength, strict=True)}
    scored = {r.doc_id: r.score for r in ranking.score(small, model).collect()}
    assert all(math.isclose(scored[i], s, rel_tol=1e-6, abs_tol=1e-9) for i, s in wanted.items())
    # the threshold lies between two of the sample's strengths, where most labels are on their side
    right = lambda t: sum((s > t) == (q == 1) for s, q in zip(learnt, y, strict=True))
    assert right(model.threshold) == max(map(right, [*learnt, min(learnt) - 1]))


def plain_grams(text, bits):
    """Buckets of all n-grams of one text, one after the other."""
    folded = [32, *(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text or b""), 32]
    out = []
    for n in (2, 3, 4):
        for i in range(len(folded) - n + 1):
            code = sum(folded[i + k] << 8 * k for k in range(n)) * 0x9E3779B1 & 0xFFFFFFFF
            code = (code ^ code >> 15) * 0x85EBCA77 & 0xFFFFFFFF
            out.append(code >> (32 - bits))
    return out


def test_language_model_against_plain_python(monkeypatch):
    texts = [b"the cat and the dog", "der Hund und die Katze über".encode(), b"le chat et le chien", None, b"", b"Another one of THE texts", b"noch ein Satz der Welt"]
    bits, dim, epochs, rate = 10, 3, 4, 0.5
    for t in texts:
        assert sorted(langid.grams([t], bits)[0].tolist()) == sorted(plain_grams(t, bits))
    names, label = ["a", "b", "c"], [0, 1, 2, None, None, 0, 1]
    rows = []
    for t, k in zip(texts, label, strict=True):
        if k is not None:
            found = plain_grams(t, bits)
            at, n = np.unique(found, return_counts=True)
            rows.append((at, n / len(found), k))
    model = langid.train(rows, names, bits, dim, epochs, rate)
    # the same training, number by number
    rng = np.random.default_rng(5)
    embed = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).tolist()
    weight, bias = rng.uniform(-0.1, 0.1, (dim, 3)).tolist(), [0.0] * 3
    soft = lambda z: [math.exp(v - max(z)) / sum(math.exp(u - max(z)) for u in z) for v in z]
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, share, k = rows[i]
            x = [sum(s * embed[j][m] for j, s in zip(at, share, strict=True)) for m in range(dim)]
            p = soft([sum(x[m] * weight[m][c] for m in range(dim)) + bias[c] for c in range(3)])
            p[k] -= 1
            now = rate * (1 - step / (epochs * len(rows)))
            back = [sum(weight[m][c] * p[c] for c in range(3)) for m in range(dim)]
            for m in range(dim):
                for c in range(3):
                    weight[m][c] -= now * x[m] * p[c]
            bias = [v - now * 0.1 * q for v, q in zip(bias, p, strict=True)]
            for j, s in zip(at, share, strict=True):
                for m in range(dim):
                    embed[j][m] -= now * 20 * s * back[m]
            step += 1
    logits = lambda found, heat: [(sum(sum(embed[j][m] * weight[m][c] for m in range(dim)) for j in found) / len(found) + bias[c]) / heat for c in range(3)]
    heats = np.geomspace(0.2, 20, 60)
    losses = [-sum(math.log(max(soft(logits(plain_grams(t, bits), h))[k], 1e-300)) for t, k in zip(texts, label, strict=True) if k is not None) for h in heats]
    heat = heats[int(np.argmin(losses))]
    want = np.array([soft(logits(plain_grams(t, bits), heat)) for t in texts])
    np.testing.assert_allclose(model.scores(texts), want, atol=1e-7)
    monkeypatch.setattr(langid, "PIECE", 7)  # texts over several pieces
    np.testing.assert_allclose(model.scores(texts), want, atol=1e-7)


def test_language_sample_counts_each_id_once(spark):
    rows = [(1, "the words of this text " * 3, "en")] * 50 + [(2, "ein Satz aus deutschen Wörtern", "de"), (None, "sin nombre", "es"), (3, None, "fr"), (4, "quelques mots encore", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train=2)
    assert model.languages == ["de", "en"]


GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_wrapped_notices(spark):
    """Every text of every family, wrapped at some width and behind some comment mark; no line is a text of the training."""
    m = licenses.fitted()
    rows, want = [], []
    for f, ts in licenses.licence_texts().items():
        for t in ts:
            for width, mark in ((50, " * "), (72, "# "), (33, "")):
                lines = textwrap.wrap(t, width, break_on_hyphens=False, break_long_words=False)
                if len(lines) > 1 or width == 72:
                    rows.append((len(rows), "a line of prose before it\n\n" + "\n".join(mark + x for x in lines) + "\n\nand another one"))
                    want.append(f)
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    wrong = [(rows[i][1][26:-18], f, got[i]) for i, f in enumerate(want) if got[i] != f]
    assert not wrong, wrong


def test_notices_of_files(spark):
    m = licenses.fitted()
    mit = """/*
 * Copyright (c) 2021 Somebody
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy of
 * this library and its documentation, to deal in the library without restriction,
 * including without limitation the rights to use, copy, modify, merge, publish,
 * distribute, sublicense, and/or sell copies of it, and to permit persons
 * to whom it is furnished to do so, subject to the following conditions:
 */
int main() {}"""
    bsd = "# Redistribution and use in source and binary\n# forms, with or without changes, are permitted\n# provided that the following conditions\n# are met:\n#\n# * Redistributions of source code must retain\n#   the above copyright notice and this list of conditions."
    gpl2 = GPL_HEADER.replace("version 3", "version 2").replace("program is", "file is part of the kit, which is")
    rows = [
        (0, GPL_HEADER, "gpl-3.0"), (1, gpl2, "gpl-2.0"), (2, f"some words\nand more\n \t\r\n{GPL_HEADER}\n\nmore words", "gpl-3.0"), (3, mit, "mit"), (4, bsd, "bsd"),
        (5, "// SPDX-FileCopyrightText: 2020 Somebody\n// SPDX-License-Identifier: MIT\n#include <x>", "mit"), (6, "#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-or-later\nset -e", "gpl-2.0"),
        (7, "This package is made available\nunder the Apache License,\nVersion 2.0 by its authors", "apache-2.0"), (8, "all rights reserved for the seat", "unknown"), (9, "the tower gave permission to land", "none"),
        (10, GPL_HEADER.replace("General", "Affero General"), "agpl-3.0"), (11, GPL_HEADER.replace("General", "Lesser General").replace("version 3", "version 2.1").replace("program", "library"), "lgpl-2.1"),
        (12, "text by X, CC BY-SA 3.0\nThis work is licensed under a Creative Commons\nAttribution-ShareAlike 3.0 Unported License.", "cc-by-sa-3.0"), (13, "some\nwords", "none"), (14, "\n\n", "none"),
        (15, "Eclipse Public\nLicense 2.0 applies to this file", "unknown"),
    ]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, want string"), m).collect()}
    assert [(i, w, got[i]) for i, _, w in rows if got[i] != w] == []
    assert [brute_licence(t, m)[0] for _, t, _ in rows] == [got[i] for i, _, _ in rows]


@pytest.mark.parametrize("piece", [7, 1000, 1 << 18])
def test_long_texts_are_counted_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = np.random.default_rng(piece)
    for text in ("", "a", "ab", "Ab é", " ".join("".join(rng.choice(list("abcdéß日 "), 9)) for _ in range(400))):
        found, _ = langid.grams([text.encode()], 12)
        assert langid.gram_counts(text.encode(), 12).tolist() == np.bincount(found, minlength=1 << 12).tolist()
    assert langid.has_letter("日本".encode() * 20) and not langid.has_letter("12 -- … “”".encode() * 50)
    rows = [("some words of a text " * 40).encode(), b"short", None, ("andere Wörter " * 60).encode()]
    model = langid.LanguageModel(["a", "b", "c"], 12, rng.normal(size=(1 << 12, 3)), rng.normal(size=3), 0.5)
    plain = model.scores(rows)
    monkeypatch.setattr(langid, "LONG", 100)
    assert np.allclose(model.scores(rows), plain, atol=1e-12)
