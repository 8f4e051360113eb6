import collections
import hashlib
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandline.llm import media, mixing, queries, repeats
from tests.llm.conftest import SF, thue_morse


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def longest(w):
    """By brute force: the longest string from each word that occurs elsewhere too."""
    n, out = len(w), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=24), max_size=5))
def test_longest_repeats(texts):
    flat = np.array(["abc".index(c) for t in texts for c in t], dtype=np.int64)
    size = [len(t) for t in texts]
    owner, stop = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
    want = [x for t in texts for x in longest(t)]
    for least in (1, 3):
        assert repeats.longest_repeats(flat, owner, stop, least).tolist() == [x if x >= least else 0 for x in want]


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=20))
def test_intervals(s):
    order = sorted(range(len(s)), key=lambda i: s[i:])
    common = [next((k for k in range(len(s)) if s[a + k : a + k + 1] != s[b + k : b + k + 1] or not s[a + k : a + k + 1]), 0) for a, b in zip(order, order[1:], strict=False)]
    for depth, i, j in repeats.lcp_intervals(common):
        assert len({s[order[k] : order[k] + depth] for k in range(i, j + 1)}) == 1
        assert min(common[i:j]) == depth and (i == 0 or common[i - 1] < depth) and (j == len(common) or common[j] < depth)


def brute_rules(text):
    w = words(text)
    m = longest(w)

    def cover(k, size):
        hit = set()
        for i, x in enumerate(m):
            if x >= k:
                hit.update(range(i, i + size(x)))
        return len(hit)

    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = cover(repeats.WINDOW, lambda x: repeats.WINDOW)
    long = cover(repeats.MIN_REPEAT, lambda x: x)
    failed = len(w) < repeats.MIN_WORDS or 100 * seen > repeats.MAX_WINDOW_PERCENT * len(w)
    kept = not failed and long <= repeats.MAX_COVERED * len(w) and max(m, default=0) <= repeats.MAX_REPEAT
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), seen, long, max([x for x in m if x >= repeats.WINDOW], default=0), failed, kept)


def test_rules(odd, small, nothing):
    some = small.filter("length(text) < 2500")
    for docs in (odd.filter("doc_id is null or doc_id not in (8, 10)"), some):
        want = sorted(((r.doc_id, *brute_rules(r.text)) for r in docs.collect()), key=str)
        assert sorted(map(tuple, repeats.repetition_rules(docs).collect()), key=str) == want
    got = {r.doc_id: r for r in repeats.repetition_rules(odd.filter("doc_id in (8, 10)")).collect()}
    assert (got[8].n_words, got[8].longest_repeat, got[8].kept) == (3000, 2999, False) and got[10].base_failed
    kept = repeats.keep_rows(some)
    assert kept.columns == some.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in some.collect() if brute_rules(r.text)[-1])
    assert repeats.repetition_rules(nothing).count() == repeats.keep_rows(nothing).count() == 0


def test_words_and_lines_with_equal_polynomials(spark):
    a, b = thue_morse(1024), thue_morse(1024, "ba")
    text = f"{a} {b}\n{a}\n{b}\n{a} {a} one two three four five six {b} {b} one two three four five six"
    rows = [(0, text), (1, f"{a}\n{b}"), (2, f"{a}\n{a}")]
    got = sorted(map(tuple, repeats.repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(i, *brute_rules(t)) for i, t in rows] and [r[4] for r in got] == [0, 0, 1]


def test_rule_that_only_the_method_finds(spark):
    rng = np.random.default_rng(0)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    part = fresh(120)
    rows = [(0, f"{fresh(700)} {part} {fresh(50)} {part} {fresh(30)}"), (1, fresh(900))]
    got = {r.doc_id: r for r in repeats.repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[0].base_failed and not got[0].kept and got[0].longest_repeat == 120 and got[0].covered_words == 240 and got[1].kept


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=9000))
def test_media_round_trip(data):
    payload = media.pad(data)
    assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.rstrip(b" ") == data.rstrip(b" ")
    file = media.pack(payload)
    seen = media.describe(file)
    assert media.samples(file, seen) == payload and seen["codec"] == "raw "
    for at, size in zip(seen["offsets"][seen["keys"]], seen["sizes"][seen["keys"]], strict=True):
        assert file[at : at + size] == payload[(at - seen["offsets"][0]) : (at - seen["offsets"][0]) + 192]
    assert seen["duration"] == len(payload) // 192 * media.TICKS and seen["keys"].tolist() == list(range(0, len(payload) // 192, media.KEY_EVERY))


def test_other_containers():
    payload = bytes(range(192)) * 40
    file = media.pack(payload)
    moov = next(p for p in media.walk(file) if p[0] == (b"moov",))
    begin, end = moov[1], moov[3]
    # media data first, in a box with a 64-bit size; unknown boxes; a moov that reaches to the end
    data = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) + payload
    shift = 16 - media.describe(file)["offsets"][0]
    inner = file[begin + 8 : end]
    at = inner.index(b"stco") + 12
    offsets = np.frombuffer(inner, ">u4", 3, at).astype(np.int64) + shift
    inner = inner[:at] + offsets.astype(">u4").tobytes() + inner[at + 12 :]
    other = data + struct.pack(">I4s", 12, b"free") + b"1234" + struct.pack(">I4s", 0, b"moov") + inner
    seen = media.describe(other)
    assert media.samples(other, seen) == payload and [p[-1] for p, *_ in media.walk(other)][:3] == [b"mdat", b"free", b"moov"]
    for cut in (3, 20, len(file) - 5):
        assert media.read_row(file[:cut])[-1] is not None
    assert media.read_row(file.replace(b"stsz", b"xxxx"))[-1] == "no stsz"


def test_broken_files_are_errors():
    file = media.pack(media.pad(b"some text " * 400), 4000)
    error = lambda data: media.read_row(data)[-1]
    assert error(file) is None and error(None) == "no file"
    assert error(file.replace(b"stco", b"xxxx")) == "no stco"
    deep = b""
    for _ in range(3000):
        deep = struct.pack(">I4s", len(deep) + 8, b"udta") + deep
    assert error(file + deep) == "boxes nested too deep"
    at = file.index(b"stsz") + 8
    assert error(file[:at] + struct.pack(">II", 192, 0xFFFFFFF0) + file[at + 8 :]) == "a sample lies outside the file"
    assert error(file[:at] + struct.pack(">II", 0, 0xFFFFFFF0) + file[at + 8 :]) == "truncated table"
    for name in (b"stts", b"stsc", b"stss", b"stco"):
        at = file.index(name) + 8
        assert error(file[:at] + b"\xff\xff\xff\xf0" + file[at + 4 :]) == "truncated table"
    at = file.index(b"stss") + 12
    assert error(file[:at] + bytes(4) + file[at + 4 :]) == "a key frame is no sample"
    rng = np.random.default_rng(1)
    head = file.index(b"mdat")
    for _ in range(3000):  # any other damage is an error or a reading, never an exception
        damaged = bytearray(file)
        for k in rng.integers(0, head, rng.integers(1, 5)):
            damaged[k] = rng.choice([0, 1, 8, 127, 255, rng.integers(0, 256)])
        media.read_row(bytes(damaged[: rng.integers(8, len(file))] if rng.random() < 0.2 else damaged))


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, *parts, version=0, flags=0):
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def track(*tables, edits=b""):
    """A moov with one video track with number 7."""
    tkhd = full(b"tkhd", struct.pack(">IIII", 0, 0, 7, 0) + bytes(68))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide")), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"vp09", bytes(78))), *tables)))
    mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, 100, 0))
    return lambda *more: box(b"moov", mvhd, box(b"trak", tkhd, edits, mdia), *more)


def test_compact_sizes_composition_and_edits():
    payload = bytes(range(1, 31))
    for bits, packed in ((4, b"\x57\x39\x60"), (8, bytes([5, 7, 3, 9, 6])), (16, struct.pack(">5H", 5, 7, 3, 9, 6))):
        tables = [
            full(b"stts", struct.pack(">5I", 2, 3, 10, 2, 20)), full(b"ctts", struct.pack(">IIiIi", 2, 1, 20, 4, -5), version=1), full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 2, 3, 1)),
            full(b"stz2", struct.pack(">3xBI", bits, 5), packed), full(b"stco", struct.pack(">3I", 2, 8, 20)), full(b"stss", struct.pack(">3I", 2, 1, 4)),
        ]
        for edits, first, duration in ((b"", 5, 70), (box(b"edts", full(b"elst", struct.pack(">IIiI", 1, 4, 15, 0x10000))), 15, 40)):
            file = box(b"mdat", payload) + track(*tables, edits=edits)()
            seen = media.describe(file)
            assert seen["offsets"].tolist() == [8, 13, 20, 23, 32] and seen["sizes"].tolist() == [5, 7, 3, 9, 6] and seen["codec"] == "vp09"
            assert media.samples(file, seen) == payload[:12] + payload[12:30]
            assert (seen["keys"].tolist(), seen["key_times"].tolist(), seen["first"], seen["duration"]) == ([0, 3], [20, 25], first, duration)


def test_fragments():
    empty = [full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4))]
    trex = box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 40, 6, 0x10000)))
    head = track(*empty)(trex)

    def fragment(data, run, flags, tfhd=b"", given=0x20000):
        make = lambda offset: box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), tfhd, flags=given), full(b"trun", run(offset), flags=flags)), box(b"traf", full(b"tfhd", struct.pack(">I", 9)), full(b"trun", struct.pack(">I", 9))))
        return make(len(make(0)) + 8) + box(b"mdat", data)

    one = fragment(b"abcdefghijkl", lambda o: struct.pack(">IiI", 2, o, 0), 0x5)  # sizes of trex, first one a key frame
    two = fragment(b"mnopqrstu", lambda o: struct.pack(">Ii6I", 2, o, 30, 4, 0, 31, 5, 0x10000), 0x701)
    three = fragment(b"vwxyz", lambda o: struct.pack(">Ii", 1, o), 0x1, struct.pack(">II", 5, 0), 0x20030)
    file = head + one + two + three
    seen = media.describe(file)
    assert media.samples(file, seen) == bytes(range(97, 123)) and seen["sizes"].tolist() == [6, 6, 4, 5, 5]
    assert (seen["keys"].tolist(), seen["key_times"].tolist(), seen["duration"]) == ([0, 2, 4], [0, 80, 141], 181)
    huge = head + fragment(b"", lambda o: struct.pack(">Ii", 0xFFFFFFF0, o), 0x1)
    assert media.read_row(huge)[-1] == "truncated table"


def test_media_of_documents(odd, small, nothing):
    for docs in (odd, small):
        got = media.media_columns(docs).collect()
        by_id = collections.Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32, r.payload_bytes) for r in got)
        want = collections.Counter()
        for r in docs.collect():
            p = media.pad((r.text or "").encode())
            want[r.doc_id, len((r.text or "").encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(p)] += 1
        assert by_id == want and all(r.error is None and len(r.key_offsets) == len(r.key_lengths) for r in got)
    assert media.media_columns(nothing).count() == 0


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def brute_mix(rows, weights, total, seed, by_row=False):
    """Copies by (id, source), or of each row."""
    n = collections.Counter(s for _, s, _ in rows)
    ok = {s: w for s, w in weights.items() if s in n and w is not None and w > 0}
    copies = []
    for doc, s, text in rows:
        copies.append(0)
        if s in ok:
            name = f"null:{hashlib.md5((text or '').encode()).hexdigest()}" if doc is None else doc
            rate = ok[s] / sum(ok.values()) * total / n[s]
            parts = max(1, math.ceil(rate / mixing.PART))
            for j in range(1, parts + 1):
                u = int(hashlib.md5(f"{seed}:{j}:{name}".encode()).hexdigest()[:13], 16) / 2**52
                copies[-1] += poisson(u, rate / parts)
    if by_row:
        return copies
    out = collections.Counter()
    for (doc, s, _), k in zip(rows, copies, strict=True):
        out[doc, s] += k
    return out


@pytest.mark.parametrize("few", [5000, 0])
def test_mix(spark, odd, small, monkeypatch, few):
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", few)
    for docs, weights, total in ((small, {"src0": 3.0, "src1": 1.0, "none": 5.0, "src2": -1.0}, 900.0), (odd, {"s": 1.0, None: 2.0}, 300.0), (small.filter("source = 'src3'"), {"src3": 1.0}, 2000.0)):
        w = spark.createDataFrame(list(weights.items()), "source string, weight double")
        mixed = mixing.poisson_mix(docs, w, total)
        rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
        want = {k: v for k, v in brute_mix(rows, weights, total, 17).items() if v}
        assert collections.Counter((r.doc_id, r.source) for r in mixed.collect()) == want
        assert mixed.columns == [c for c in docs.columns if c not in mixing.ADDED] + ["copy", "rate"]
    assert mixing.poisson_mix(odd.limit(0), w).count() == 0


def test_mix_reaches_the_weights_and_shuffles(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    w = mixing.root_weights(docs)
    counts = {r.source: r["count"] for r in mixing.poisson_mix(docs, w).groupBy("source").count().collect()}
    share = {r.source: r.weight for r in w.collect()}
    for s, n in counts.items():
        want = 40_000 * share[s] / sum(share.values())
        assert abs(n - want) < 5 * math.sqrt(want)
    ids = [r.doc_id for r in mixing.poisson_mix(docs, w).limit(2000).collect()]
    assert np.std(ids) > 8000  # neighbours come from everywhere
    plan = mixing.poisson_mix(docs, w)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in place) for r in rel.fetchall()), key=str)
