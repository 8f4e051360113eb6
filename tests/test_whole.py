"""Queries over whole tables against brute force."""

import math
import re

import numpy as np
import pytest

from strandline.operators import sequences
from strandline.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_suffix_array(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        t = re.sub("[^ -~]", "", r.text)
        want += [(r.item_id, k, p) for k, p in enumerate(sorted(range(len(t)), key=lambda p, t=t: t[p:]))]
    assert sorted(map(tuple, catalogue.queries()["suffix_array"](spark, SF).collect())) == sorted(want)
    assert max(p for _, _, p in want) >= 40


def test_reads_to_graphs(spark):
    got = {(r.item_id, r.pos): r[2:] for r in catalogue.queries()["reads_to_graphs"](spark, SF).collect()}
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert sorted(got) == sorted((i, p) for i, t in texts.items() for p in range(len(t)))
    for (i, p), w in got.items():
        c = texts[i][p]
        error, hot = 10 ** (-(ord(c) - 33) / 10), sequences.IUPAC.get(c.upper(), "ACGT")
        want = [0.25 if len(hot) == 4 else (1 - error) / len(hot) if b in hot else error / (4 - len(hot)) for b in "ACGT"]
        assert w == pytest.approx(want, abs=1e-4)


def test_gram_matrix(spark):
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], dtype=float)
    got = {(r.row_no, r.col_no): r.v for r in catalogue.queries()["gram_matrix"](spark, SF).collect()}
    want = x.T @ x
    assert len(got) == want.size == 4096
    assert all(got[i + 1, j + 1] == pytest.approx(want[i, j], abs=1e-4) for i in range(64) for j in range(64))


def test_mixture_logpdf(spark, tmp_path):
    values = [0.0, -200.5, 400.5, 490.02, -5000.0, 1e5, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.log_pdf for r in catalogue.queries()["mixture_logpdf"](spark, str(tmp_path)).collect()}
    ln = lambda x, m, s, w: math.log(w / (s * math.sqrt(2 * math.pi))) - 0.5 * ((x - m) / s) ** 2
    want = {i: float(np.logaddexp(ln(x, 0, 10, 0.25), ln(x, 50, 40, 0.75))) for i, x in enumerate(values) if x is not None}
    assert got == pytest.approx(want, abs=2e-6)
