import math
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from strandline.functions import crypto, prob, scalar, text
from strandline.operators import aggregates, linalg, lookup, optim, patterns, rows, suffixes

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def logsum(values):
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


@FEW
@given(st.lists(st.one_of(st.just(-math.inf), st.floats(-700, 700)), max_size=12), st.floats(-50, 50))
def test_log_sums(spark, values, shift):
    got = one(spark, prob.lse_array(F.array(*map(F.lit, values)).cast("array<double>")), prob.lse_array(F.array(*(F.lit(v + shift) for v in reversed(values))).cast("array<double>")))
    assert math.isclose(got[0], logsum(values), rel_tol=1e-9, abs_tol=1e-9) or got[0] == logsum(values)
    assert got[1] == got[0] == -math.inf or math.isclose(got[1], got[0] + shift, rel_tol=1e-9, abs_tol=1e-7)


def test_grouped_log_sums(spark):
    data = [("a", 1.0), ("a", 2.0), ("b", -math.inf), (None, 0.5), (None, 0.5), ("c", 800.0), ("c", 800.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r.lse for r in prob.log_sum_exp(df, ["k"], "v").collect()}
    for k in ("a", "b", None, "c"):
        want = logsum([v for key, v in data if key == k])
        assert got[k] == want or math.isclose(got[k], want, rel_tol=1e-12)
    assert math.isclose(prob.log_sum_exp(df.filter("k = 'a'"), [], "v").first()[0], logsum([1.0, 2.0]))
    mean = {r.k: r.log_mean for r in aggregates.log_mean_exp(df, ["k"], "v").collect()}
    assert math.isclose(mean["a"], logsum([1.0, 2.0]) - math.log(2))


def test_special_functions(spark):
    x = spark.createDataFrame([(v,) for v in (0.1, 0.5, 1.0, 2.5, 5.0, 60.0)], "x double")
    for v, g, e, a in x.select("x", prob.log_gamma(F.col("x")), prob.erf(F.col("x")), prob.erf_approximate(F.col("x"))).collect():
        assert math.isclose(g, math.lgamma(v), rel_tol=1e-10, abs_tol=1e-10) and math.isclose(e, math.erf(v)) and abs(a - e) < 2e-7
    y = spark.createDataFrame([(v,) for v in (-1.0, -0.5, 0.0, 0.9, 1.0, 2.0)], "y double").select("y", prob.erf_inverse(F.col("y"))).collect()
    assert y[0][1] == -math.inf and y[4][1] == math.inf and y[5][1] is None and all(math.isclose(math.erf(v), k, abs_tol=1e-12) for k, v in y[1:4])
    assert one(spark, prob.log_of(F.lit(0.0)), prob.log_one_minus_exp(F.lit(0.0)), prob.lse_pair(F.lit(-math.inf), F.lit(-math.inf))) == (-math.inf,) * 3
    assert math.isclose(one(spark, prob.log_one_minus_exp(F.lit(-1e-12)))[0], math.log(1e-12), rel_tol=1e-6)


def test_distributions(spark):
    g = prob.Gaussian([1.0, -1.0], [[2.0, 0.6], [0.6, 1.0]])
    x, y = F.lit(1.0), F.lit(-1.0)
    assert math.isclose(one(spark, g.log_pdf(x, y))[0], -math.log(2 * math.pi) - 0.5 * math.log(2 - 0.36))
    u = prob.Uniform([0.0], [4.0])
    assert one(spark, u.log_pdf(F.lit(0.0)), u.log_pdf(F.lit(4.0))) == (-math.log(4), -math.inf)
    m = prob.Mixture()
    m.add(u)
    m.add(prob.Uniform([2.0], [6.0]))
    assert math.isclose(one(spark, m.log_pdf(F.lit(3.0)))[0], -math.log(4))
    m.set_weights([0.5, 0.5])
    assert math.isclose(one(spark, m.log_pdf(F.lit(5.0)))[0], math.log(1 / 8)) and m.bounds(0.9) == [(0.0, 6.0)]
    low, high = g.bounds(0.95)[0]
    assert low < 1 < high and g.marginal([1]).mean == [-1.0]
    drawn = np.array([r.x for r in prob.draws(spark, g, 4000, 3).collect()])
    assert np.allclose(drawn.mean(axis=0), [1, -1], atol=0.1) and np.allclose(np.cov(drawn.T), g.cov, atol=0.15)
    assert m.draw(100, np.random.default_rng(0)).shape == (100, 1)
    for bad in (lambda: prob.Uniform([1.0], [1.0]), lambda: m.set_weights([1.0]), lambda: g.bounds(1.0)):
        with pytest.raises(ValueError):
            bad()


M64 = 1 << 64
signed = st.integers(-(1 << 63), (1 << 63) - 1)


@FEW
@given(signed, signed)
def test_wrapping_arithmetic(spark, a, b):
    x, y = F.lit(a).cast("bigint"), F.lit(b).cast("bigint")
    wrap = lambda v: (v + (1 << 63)) % M64 - (1 << 63)
    got = one(spark, scalar.multiply_wrapping(x, y), scalar.add_wrapping(x, y), scalar.unsigned_less(x, y), scalar.unsigned_divide(x, y), scalar.unsigned_remainder(x, y), scalar.lcg_next(x))
    ua, ub = a % M64, b % M64
    want = (wrap(a * b), wrap(a + b), ua < ub, wrap(ua // ub) if ub else None, wrap(ua % ub) if ub else None, wrap(a * scalar.LCG_MULTIPLIER + scalar.LCG_INCREMENT))
    assert got == want


def test_scalars(spark):
    arr = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, scalar.gather(arr, F.lit(2)), scalar.gather(arr, F.lit(9)), scalar.scatter(arr, F.lit(1), F.lit(7)), scalar.loop(F.lit(1), F.lit(5), lambda s, i: s * 2), scalar.unsigned_convert(F.lit(-1), "L")) == (3, None, [1, 7, 3], 32, 0xFFFFFFFF)
    assert one(spark, scalar.unsigned_greater(F.lit(-1), F.lit(1)), scalar.unsigned_less_equal(F.lit(1), F.lit(1)), scalar.unsigned_greater_equal(F.lit(1), F.lit(-1)), scalar.as_unsigned(F.lit(-1).cast("bigint"))) == (True, True, False, 2**64 - 1)


def test_strings(spark):
    got = one(
        spark, text.split_tokens(F.lit("a,,b"), ","), text.split_first(F.lit("k=v=w"), "="), text.split_first(F.lit("kv"), "="), text.span(F.lit("aab-c"), "a-b"), text.span_without(F.lit("xy]z"), "]^"),
        text.occurrences(F.lit("aaaa"), "aa"), text.trim_text(F.lit("ababxab"), "ab"), text.parse_int(F.lit("-12")), text.parse_int(F.lit(" 1")), text.parse_float(F.lit("1.5e3")), text.parse_float(F.lit("x")), text.parse_ploidies(F.lit("2/ 1")),
    )
    assert [tuple(t) for t in got[0]] == [("a", 1), (",", 0), (",", 0), ("b", 1)]
    assert tuple(got[1]) == ("k", "v=w") and tuple(got[2]) == ("kv", None)
    assert got[3:] == (4, 2, 3, "x", -12, None, 1500.0, None, [2, 1])


def test_ciphers(spark):
    key = bytes(range(32))
    df = spark.createDataFrame([("some text",), ("",), (None,)], "c string")
    sealed = df.select("c", crypto.encrypt(F.col("c"), F.lit(key)).alias("s"), crypto.encrypt_block(F.col("c"), F.lit(key)).alias("b"))
    for c, a, b in sealed.select("c", crypto.decrypt("s", F.lit(key)).cast("string"), crypto.decrypt_block("b", F.lit(key)).cast("string")).collect():
        assert a == c and b == c
    whole = one(spark, crypto.key_stream(F.lit(key), 7, F.lit(0).cast("bigint"), F.lit(4)))[0]
    tail = one(spark, crypto.key_stream(F.lit(key), 7, F.lit(2).cast("bigint"), F.lit(2)))[0]
    assert len(whole) == 64 and whole[32:] == tail
    # the first block of the standard's example F.5.5
    key = bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4")
    plain, sealed = bytes.fromhex("6bc1bee22e409f96e93d7e117393172a"), bytes.fromhex("601ec313775789a5b7a7f504bbf3d228")
    first = F.lit(0xF8F9FAFBFCFDFEFF - (1 << 64)).cast("bigint")
    assert one(spark, crypto.counter_mode(F.lit(plain), F.lit(key), 0xF0F1F2F3F4F5F6F7, first))[0] == sealed
    back = df.select("c", crypto.counter_mode(crypto.counter_mode(F.col("c"), F.lit(key), 9), F.lit(key), 9).cast("string"))
    assert all(a == b for a, b in back.collect())
    assert one(spark, crypto.sha256(F.lit("abc")), crypto.crc32(F.lit("123456789"))) == ("ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", 0xCBF43926)


def test_patterns(spark):
    a, b = patterns.literal("ab"), patterns.charset("abc").star()
    auto = patterns.Automaton(a, b, patterns.literal("abcabc-"))
    assert auto.match("abcab-") == (5, (1,)) and auto.match("ab") == (2, (0, 1)) and auto.match("-") == (0, (1,))
    assert patterns.Automaton(a).match("x") == (-1, ())
    node = patterns.literal("a") | patterns.literal("abcd")
    assert patterns.Automaton(node).find_long("xa abcd a") == (3, 4) and patterns.Automaton(node).find_first("xabcd") == (1, 1) and patterns.Automaton(node).find_first("xx") == (-1, -1)
    assert auto.tokens("ab-x") == ([("ab", [0, 1])], "-x")
    df = spark.createDataFrame([("xa abcd a",), ("zzz",), (None,)], "c string")
    got = df.select(patterns.find_long_udf(node)("c"), patterns.find_first_udf(node)("c"), patterns.matches(F.col("c"), patterns.charset("z").star()), patterns.first_match(F.col("c"), node), patterns.tokenize_udf(patterns.charset("xa"), patterns.literal(" "))("c")).collect()
    assert tuple(got[0][0]) == (3, 4) and tuple(got[0][1]) == (1, 1) and not got[0][2] and got[0][3] == "a" and [t.text for t in got[0][4]] == ["x", "a", " ", "a"]
    assert tuple(got[1][0]) == (-1, -1) and got[1][2] and got[1][3] is None and got[2][4] is None
    with pytest.raises(ValueError):
        patterns.charset("")


@FEW
@given(st.text("ACGT", max_size=200).map(lambda s: s * 3))
def test_suffix_arrays(spark, s):
    order = suffixes.suffix_array(s)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    search = suffixes.Search(s, order)
    for k, c in enumerate("ACG", 1):
        prefix = "ACG"[:k]
        assert search.limit(c) == sum(s.startswith(prefix, i) for i in range(len(s)))


def test_linear_algebra(spark):
    rng = np.random.default_rng(0)
    for n in (1, 3, 6):
        m = rng.normal(size=(n, n))
        spd = m @ m.T + n * np.eye(n)
        low = linalg.cholesky(spd)
        assert np.allclose(low @ low.T, spd) and np.allclose(linalg.invert(spd) @ spd, np.eye(n)) and np.allclose(spd @ linalg.solve(spd, np.ones(n)), 1)
        assert math.isclose(linalg.largest_eigenvalue(spd), np.linalg.eigvalsh(spd).max(), rel_tol=1e-6)
    lit = lambda m: F.array(*(F.array(*map(F.lit, r)) for r in m))
    a, b = [[1.0, 2.0], [3.0, 4.0]], [[0.5, 1.0], [2.0, 8.0]]
    got = one(spark, linalg.add(lit(a), lit(b)), linalg.subtract(lit(a), lit(b)), linalg.multiply_cells(lit(a), lit(b)), linalg.divide_cells(lit(a), lit(b)), linalg.multiply(lit(a), lit(b)), linalg.transpose(lit(a)), linalg.add_scalar(lit(a), 1.0), linalg.multiply_scalar(lit(a), 2.0))
    x, y = np.array(a), np.array(b)
    for g, w in zip(got, (x + y, x - y, x * y, x / y, x @ y, x.T, x + 1, 2 * x), strict=True):
        assert np.allclose(g, w)
    cells = spark.createDataFrame([(i, j, a[i][j]) for i in range(2) for j in range(2)], "i long, j long, v double")
    product = {(r.i, r.j): r.v for r in lookup.multiply(cells, cells).collect()}
    assert all(math.isclose(product[i, j], (x @ x)[i, j]) for i in range(2) for j in range(2))


def test_optimizers(spark):
    assert math.isclose(optim.golden_section(lambda t: (t - 1.25) ** 2, -4, 9), 1.25, abs_tol=1e-5)
    bowl = optim.many(lambda p: (p[0] - 1) ** 2 + 10 * (p[1] + 2) ** 2 + p[0] * p[1])
    exact = np.linalg.solve([[2, 1], [1, 20]], [2, -40])
    for f in (optim.lbfgs, optim.gradient_descent):
        assert np.allclose(f(bowl, [0.0, 0.0]), exact, atol=1e-2)
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(20)], "x double, y double").cache()
    loss = optim.over_frame(df, lambda p: F.pow(F.col("y") - p[0] * F.col("x") - p[1], 2) / 20)
    assert np.allclose(optim.lbfgs(loss, [0.0, 0.0], rounds=6), [3, 1], atol=0.05)


def test_rows_and_lookups(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}") for i in range(10)], "row_id long, k string")
    assert [r.row_id for r in rows.row_range(df, 2, 5).orderBy("row_id").collect()] == [2, 3, 4]
    assert [r.row_id for r in rows.page(df, ["row_id"], 3, 4).collect()] == [4, 5, 6]
    assert rows.mutate(df, z=F.lit(1)).columns[-1] == "z" and rows.keep(df, F.col("row_id") > 7).count() == 2
    assert [r.row_id for r in rows.merge_sorted(df.filter("row_id < 5"), df.filter("row_id >= 5"), ["row_id"]).collect()] == list(range(10))
    assert sorted((r.row_id, r.k) for r in rows.numbered(df.select("k")).collect()) == [(i, f"k{i % 3}") for i in range(10)]
    assert len(rows.split_points(df, "row_id", 4)) == 3 and rows.split_points(df, "row_id", 1) == []
    dim = lookup.levels(df, "k")
    coded = lookup.encode_factor(df, "k", dim)
    assert {(r.k, r.code) for r in coded.collect()} == {("k0", 0), ("k1", 1), ("k2", 2)}
    assert lookup.decode_factor(coded.select("row_id", "code"), "code", dim, "k").filter("k is null").count() == 0
    with pytest.raises(Exception, match="unknown code"):
        lookup.decode_factor(coded.select((F.col("code") + 5).alias("code")), "code", dim, "k").collect()
    assert one(spark, lookup.level_code(F.lit("b"), {"a": 0, "b": 1}))[0] == 1
    with pytest.raises(ValueError):
        rows.row_range(df, 5, 2)


@pytest.mark.parametrize("chunk", [3, 16, 1024])
def test_matches_of_every_place_against_a_walk(chunk, monkeypatch):
    """Longest and shortest matches over chunks that cut the texts anywhere."""
    monkeypatch.setattr(patterns, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    letters, lit, set_ = "abcd日", patterns.literal, patterns.charset
    nodes = [set_("abc") + set_("abc").star(), lit("ab") + set_("bc").star() + lit("a"), (lit("a") | lit("ab")) + lit("c").star(), patterns.EMPTY, lit("aa").star(), lit("日") + set_("ab日").star()]
    texts = ["".join(rng.choice(list(letters), int(rng.integers(0, 90)))) for _ in range(60)] + ["", "a" * 200]
    for node in nodes:
        auto = patterns.Automaton(node)
        for longest in (True, False):
            out, bounds = auto.tables.ends(texts, longest)
            for t, low in zip(texts, bounds.tolist(), strict=False):
                got = [-1 if v < 0 else v // auto.tables.kinds - i for i, v in enumerate(out[low : low + len(t) + 1].tolist())]
                assert got == [auto.match(t, i, longest)[0] for i in range(len(t) + 1)]


def test_patterns_take_time_in_proportion_to_the_text():
    """A million equal letters, for which a walk from every place would take a million million steps."""
    letters = patterns.charset("abc")
    began = time.perf_counter()
    assert patterns.Automaton(letters + letters.star()).find_long("x" + "a" * 1_000_000) == (1, 1_000_000)
    found, rest = patterns.Automaton(patterns.literal("a"), patterns.literal("a").star() + patterns.literal("b")).tokens("a" * 300_000 + "c")
    assert len(found) == 300_000 and rest == "c" and time.perf_counter() - began < 30


def test_tokens_as_a_table_function(spark):
    patterns.register_tokenizer(spark, "tokens_of", patterns.charset("ab") + patterns.charset("ab").star(), patterns.literal("ab"), patterns.literal(" "))
    spark.createDataFrame([(1, "ab ba!x"), (2, ""), (3, None), (4, "!")], "k long, s string").createOrReplaceTempView("said")
    got = spark.sql("SELECT k, t.* FROM said, LATERAL tokens_of(s) t").collect()
    assert sorted((r.k, r.place, r.token, tuple(r.types), r.rest) for r in got) == [(1, 0, "ab", (0, 1), "!x"), (1, 1, " ", (2,), "!x"), (1, 2, "ba", (0,), "!x")]
    udf = patterns.tokenize_with_rest_udf(patterns.literal("a"))
    assert [(r.x.rest if r.x.rest is not None else None, None if r.x.tokens is None else len(r.x.tokens)) for r in spark.table("said").orderBy("k").select(udf("s").alias("x")).collect()] == [("b ba!x", 1), ("", 0), (None, None), ("!", 0)]


def test_exact_places_of_ranks(spark):
    rng = np.random.default_rng(2)
    values = [float(v) for v in rng.normal(0, 1e6, 700)] + [3.5] * 500 + [-1e308, 1e308, 5e-324, 0.0, 1.0, 1.0 + 2**-52] + [float(v) for v in rng.integers(0, 4, 300)]
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "x double").repartition(5)
    for parts in (2, 7, 100):
        s = sorted(values)
        want = [s[-(-len(s) * k // parts) - 1] for k in range(1, parts)]
        assert rows.split_places(df, "x", parts) == [(x, sum(v < x for v in s), sum(v <= x for v in s)) for x in want]
    assert rows.split_places(df.limit(0), "x", 4) == []


def test_loads_and_multisets_of_any_number(spark):
    df = spark.createDataFrame([(1, k % 3, k) for k in range(100)] + [(2, 1, 5)], "g long, a int, n long")
    got = sorted(map(tuple, aggregates.loading_by_allele(df, ["g"], "a", "n", 4).collect()))
    assert got == [(1, a, sum(k for k in range(100) if k % 3 == a)) for a in range(4)] + [(2, a, 5 if a == 1 else 0) for a in range(4)]
    many = df.groupBy("g").agg(F.collect_list("a").alias("x")).select("g", F.size(aggregates.canonical_multiset(F.col("x"))).alias("n"))
    assert sorted(map(tuple, many.collect())) == [(1, 100), (2, 1)]


@pytest.mark.parametrize("texts", [["banana", None, "", "banana", "ban"], ["日本ab" * 9, "x" * 300, "日本"], ["a"], []])
def test_one_suffix_array_over_joined_texts(spark, texts):
    """Repeats longer than a text, other alphabets, runs of equal letters."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").repartition(3)
    whole = "".join((t or "") + "\n" for t in texts)
    codes = suffixes.joined_codes(df, "k", "t")
    assert "".join(chr(r.code) for r in codes.orderBy("pos").collect()) == whole
    got = [r.pos for r in suffixes.suffix_array_of(codes).orderBy("rank").collect()]
    assert got == sorted(range(len(whole)), key=lambda i: whole[i:]) == suffixes.suffix_array(whole).tolist()


def test_one_suffix_array_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500")
    whole = "".join((r.text or "") + "\n" for r in docs.orderBy("doc_id", "text").collect())
    got = suffixes.suffix_array_of(suffixes.joined_codes(docs, "doc_id", "text")).orderBy("rank").toPandas()
    assert got["rank"].tolist() == list(range(len(whole))) and (got["pos"].to_numpy() == suffixes.suffix_array(whole)).all() and len(whole) > 50_000
