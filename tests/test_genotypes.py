import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import aggregates, genotypes as G, sequences


def total(c="counts"):
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)


def test_enumeration(spark):
    got = G.genotypes(spark, 3, (2, 1)).orderBy("geno_idx").collect()
    want = list(itertools.product(range(3), repeat=3))
    assert [tuple(r.alleles) for r in got] == want
    canon = [(*sorted(g[:2]), g[2]) for g in want]
    ranks = {c: i for i, c in enumerate(sorted(set(canon)))}
    assert [r["class"] for r in got] == [ranks[c] for c in canon]
    assert [tuple(r.load) for r in G.loadings(spark, 4, (1, 1)).orderBy("load_idx").collect()] == [(4, 0), (3, 1), (2, 2)]
    assert [tuple(r.load) for r in G.loadings(spark, 3, (2, 1)).orderBy("load_idx").collect()] == [(1, 1), (0, 3)]


def test_loads_without_cycles(spark):
    p = G.Parameters(2, 2, (1, 1))
    rows = G.simulate(spark, p).filter("geno_idx = 1 and rep = 0").orderBy("load_idx").collect()
    assert [r.counts for r in rows] == [[2, 0], [1, 1]]
    assert G.simulate(spark, G.Parameters(2, 2, (1, 1), fan=33)).count() == 4 * 2 * 64


def test_amplification(spark):
    double = G.simulate(spark, G.Parameters(3, 4, (2,), cycles=3, efficiency=1.0))
    assert {r[0] for r in double.select(total()).distinct().collect()} == {4 * 8}
    rng = np.random.default_rng(0)
    start = np.array([[5, 0], [0, 7]])
    assert (G.amplify(start, G.Parameters(2, 1, (1,), cycles=4, max_react=0), rng) == start).all()
    capped = G.amplify(np.full((200, 2), 50), G.Parameters(2, 1, (1,), cycles=30, efficiency=1.0, max_react=1000), rng).sum(axis=1)
    assert (capped <= 100 + 1000 + 1000).all() and (capped > 900).all()
    stutter = G.mutation_matrix(G.Parameters(3, 1, (1,), stutter=(0.1, 0.2)))
    assert np.allclose(stutter, [[0.8, 0.2, 0], [0.1, 0.7, 0.2], [0, 0.1, 0.9]])
    assert np.allclose(G.flat_errors(3, 0.3), [[0.7, 0.15, 0.15], [0.15, 0.7, 0.15], [0.15, 0.15, 0.7]])


def test_bad_parameters():
    for bad in ({"alleles": 0}, {"load": -1}, {"ploidies": ()}, {"efficiency": 1.1}, {"error": -0.1}, {"fan": 0}):
        with pytest.raises(ValueError):
            G.Parameters(**({"alleles": 2, "load": 2, "ploidies": (1,)} | bad))


def test_reads_and_shares(spark):
    e = G.flat_errors(2, 0.1)
    df = spark.createDataFrame([([3, 1],), ([0, 0],)], "c array<bigint>")
    got = df.select(G.draw_shares(F.col("c"), e), G.draw_cdf(F.col("c"), e), aggregates.proportions(F.col("c"))).collect()
    assert np.allclose(got[0][0], [0.75 * 0.9 + 0.25 * 0.1, 0.25 * 0.9 + 0.75 * 0.1]) and np.allclose(got[1][0], [0.5, 0.5])
    assert np.allclose(got[0][1], [got[0][0][0], 1.0]) and got[0][2] == [0.75, 0.25] and got[1][2] == [0.5, 0.5]
    sims = G.simulate(spark, G.Parameters(2, 2, (1, 1))).filter("rep = 0")
    draws = G.draw_reads(sims, 2, 0.0, 5)
    assert draws.count() == sims.count() * 6
    wrong = draws.join(sims.select("load_idx", "geno_idx", "counts"), ["load_idx", "geno_idx"]).filter("(counts[0] = 0 and reads[0] > 0) or (counts[1] = 0 and reads[1] > 0)")
    assert wrong.count() == 0 and draws.filter(total("reads") != F.col("n_reads")).count() == 0


def brute(counts_of, reads, error, n):
    """log P by (load, class) from simulated counts {(load, geno): (class, [counts])}."""
    e, by = G.flat_errors(n, error), {}
    for (load, _), (cls, reps) in counts_of.items():
        logs = []
        for c in reps:
            share = e @ (np.array(c) / sum(c) if sum(c) else np.full(n, 1 / n))
            logs.append(sum(r * math.log(s) if s > 0 else -math.inf for r, s in zip(reads, share, strict=True) if r))
        by.setdefault((load, cls), []).extend(math.exp(x) / len(reps) for x in logs)
    return {k: math.log(sum(v)) if sum(v) else -math.inf for k, v in by.items()}


@pytest.mark.parametrize("error", [0.0, 0.1])
def test_scores_and_answers(spark, error):
    p = G.Parameters(2, 2, (1, 1), cycles=2, efficiency=0.8, error=0.05)
    sims = G.simulate(spark, p).cache()
    draws = G.draw_reads(sims.filter("rep = 0"), 2, error, 3).cache()
    scores = G.score_reads(draws, sims, 2, error).cache()
    counts: dict = {}
    for r in sims.collect():
        counts.setdefault((r.load_idx, r.geno_idx), (r["class"], []))[1].append(r.counts)
    got: dict = {}
    for r in scores.collect():
        got.setdefault(r.draw_id, {})[r.load_idx, r["class"]] = r.log_p
    rows = draws.collect()
    answers = {r.draw_id: r for r in G.marginals(scores, draws.select("draw_id", "load_idx", "class")).collect()}
    close = lambda a, b: a == b or math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-8)
    for d in rows[:20]:
        want = brute(counts, d.reads, error, 2)
        assert all(close(got[d.draw_id][k], v) for k, v in want.items())
        a, mass = answers[d.draw_id], {k: math.exp(v) for k, v in want.items()}
        everything = sum(mass.values())
        load, cls = d.load_idx, d["class"]
        ln = lambda x, y=1.0: math.log(x / y) if x > 0 else -math.inf
        assert close(a.ln_joint_right, ln(mass[load, cls], everything))
        assert close(a.ln_load_right, ln(sum(v for (i, _), v in mass.items() if i == load), everything))
        assert close(a.ln_class_right, ln(sum(v for (_, j), v in mass.items() if j == cls), everything))
        given = sum(v for (i, _), v in mass.items() if i == load)
        assert close(a.ln_class_given_load_right, ln(mass[load, cls], given))
        wrong = {k: v for k, v in want.items() if k != (load, cls) and v > -math.inf}
        assert close(a.ln_joint_wrong, ln(max(map(math.exp, wrong.values()), default=0), everything))
    report = G.report(G.marginals(scores, draws.select("draw_id", "load_idx", "class")), draws, 2)
    assert report.columns[:3] == ["RC0", "RC1", "RightLoading"] and len(report.columns) == 20 and report.count() == len(rows)
    parts = G.individual_marginals(scores, G.class_genotypes(G.genotypes(spark, 2, (1, 1)), (1, 1)))
    some = rows[0]
    want = brute(counts, some.reads, error, 2)
    for i in (0, 1):
        mine = {r.genotype: r.log_p_individual for r in parts.filter((F.col("draw_id") == some.draw_id) & (F.col("individual") == i)).collect()}
        assert close(math.log(sum(math.exp(v) for v in mine.values())), math.log(sum(math.exp(v) for v in want.values())))


def test_base_weights(spark):
    df = spark.createDataFrame([("A",), ("m",), ("V",), ("N",), ("?",)], "c string")
    got = {r.c: r.w for r in df.select("c", sequences.iupac_weights(F.col("c"), F.lit(0.3)).alias("w")).collect()}
    assert np.allclose(got["A"], [0.7, 0.1, 0.1, 0.1]) and np.allclose(got["m"], [0.35, 0.35, 0.15, 0.15])
    assert np.allclose(got["V"], [0.7 / 3] * 3 + [0.3]) and got["N"] == got["?"] == [0.25] * 4
    table = sequences.substitution_table("ACGT", 0.3, ["NACGT", "RAG"])
    assert table["N"] == [0.25] * 4 and np.allclose(table["R"], [0.35, 0.15, 0.35, 0.15]) and "x" not in table
    for bad in (lambda: sequences.substitution_table("ACGT", 2), lambda: sequences.substitution_table("AC", 0.1, ["NX"]), lambda: sequences.flat_indels([0.1] * 5)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("records", ["7", "10000"])
def test_simulations_do_not_depend_on_batches(spark, records):
    p = G.Parameters(3, 4, (1, 1), cycles=3, efficiency=0.7, error=0.1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, records)
    try:
        sims = G.simulate(spark, p)
        assert sims.select(F.sum(total())).first()[0] == TOTAL.setdefault("sims", sims.select(F.sum(total())).first()[0])
        draws = G.draw_reads(sims.repartition(int(records) % 5 + 2), 3, 0.1, 3)
        digest = draws.select(F.sum(F.xxhash64("draw_id", "reads").cast("decimal(38,0)")), F.count_distinct("draw_id"), F.count(F.lit(1))).first()
        assert digest == TOTAL.setdefault("draws", digest) and digest[1] == digest[2]
    finally:
        spark.conf.set(key, before)


TOTAL: dict = {}


def test_scores_in_blocks(spark, monkeypatch):
    p = G.Parameters(2, 2, (1, 1), cycles=1, efficiency=0.8, error=0.05)
    sims = G.simulate(spark, p).cache()
    draws = G.draw_reads(sims.filter("rep = 0"), 2, 0.1, 3).cache()
    whole = {(r.draw_id, r.load_idx, r["class"]): r.log_p for r in G.score_reads(draws, sims, 2, 0.1).collect()}
    monkeypatch.setattr(G, "VECTORS", 10)
    monkeypatch.setattr(G, "DRAWS", 3)
    parts = {(r.draw_id, r.load_idx, r["class"]): r.log_p for r in G.score_reads(draws, sims, 2, 0.1).collect()}
    assert parts.keys() == whole.keys() and all(math.isclose(parts[k], whole[k], rel_tol=1e-9) for k in whole)
