import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from strandline.llm import bpe, dac, textkit
from tests.llm.conftest import thue_morse

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ALPHABET = ["a", "B", " ", "  ", "\n", "\t", "é", "é", "́", "1", "42", "'s", "'", "!", "<|endoftext|>", "<|startoftext|>", "<|", " ", "　", "ΣΑΣ", "ß", "日本", "😀", "\x1c", "\x00", "\x85", "İ", "don't", "we'll", " 's"]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_equal_the_library(path):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", None]
    encoder = bpe.UnitEncoder(path)
    for _ in range(2):  # without and with what the encoder remembers
        ids, bounds = encoder.encode([t if t is None else t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library(path, texts)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_with_equal_polynomials(path, monkeypatch):
    texts = [f"{thue_morse(n, a)} {thue_morse(n, b)} {thue_morse(n, a)}" for n in (16, 1024, 4096, 8192) for a, b in (("ab", "ba"), ("01", "10"))]
    assert_encodes(path, texts)
    monkeypatch.setattr(bpe, "blend", lambda low, high: high & np.uint64(3))  # nearly all units share their short key
    bpe.UnitEncoder.of(path).forget()
    assert_encodes(path, [*texts, "the cat sat on the mat", "a bb ccc dddd eeeee the cat"] * 2)


def assert_encodes(path, texts):
    encoder = bpe.UnitEncoder(path)
    for _ in range(2):
        ids, bounds = encoder.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library(path, texts)


def test_chunks_and_given_codes(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_UNITS", 3)
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(60)) for _ in range(500)]
    for path in (BYTE, WORD):
        encoder = bpe.UnitEncoder(path)
        regular = [t for t in texts if not bpe.OTHER_BLANKS.search(t.encode())] if path == BYTE else texts
        c = bpe.Chunks(encoder, [t.encode() for t in regular])
        tok = Tokenizer.from_file(path)
        codes = {tuple(k): np.array(tok.encode(c.text(i).decode(), add_special_tokens=False).ids, dtype=np.uint32) for i, k in enumerate(c.key.tolist()) if i % 2}
        for given in (None, codes):
            ids, bounds = bpe.assemble(encoder, c, given)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library(path, regular)


def test_repair_replaces_wrong_joints():
    encoder = bpe.UnitEncoder(WORD)
    text = b"alpha beta gamma delta epsilon zeta eta theta"
    c = bpe.Chunks(encoder, [text])
    c.units = np.array([0, 3, 8])
    c.begin, c.end = c.spans[0][[0, 3]], c.spans[1][[2, 7]]
    left, right = (np.array(library(WORD, [t])[0], dtype=np.uint32) for t in ("alpha beta gamma", "delta epsilon zeta eta theta"))
    whole = library(WORD, [text.decode()])[0]
    for a in (left, np.append(left[:-1], np.uint32(1))):  # a right and a wrong end
        x, y = bpe._repair(encoder, c, 0, a, right)
        assert np.concatenate([x, y]).tolist() == whole


def expected_digests(rows):
    tok = Tokenizer.from_file(WORD)
    out = []
    for (i, t), ids in zip(rows, library(WORD, [t for _, t in rows]), strict=True):
        plain = tok.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def test_digests(odd, small, nothing):
    for docs in (odd, small):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(map(tuple, bpe.encode_digests(docs, WORD).collect()), key=str) == expected_digests(rows)
    assert bpe.encode_digests(nothing, WORD).count() == 0


def test_digests_of_shared_chunks(spark):
    rng = random.Random(6)
    passage = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(400))
    rows = [(i, f"{thue_morse(64 + i)} start{i} {passage} {'ab' * i} {passage if i % 3 else ''}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for path in (WORD, BYTE):
        got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.encode_digests(docs, path).collect()}
        want = {i: (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for (i, _), x in zip(rows, library(path, [t for _, t in rows]), strict=True)}
        assert got == want


def test_shard_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 8, 511, 513, 3000):
        for high in (1, 257, 50_000, 1 << 32):
            ids = rng.integers(0, high, n).astype(np.uint32)
            levels = dac.pack(ids)
            assert (dac.unpack([x[:2] for x in levels]) == ids).all()
            taken = []

            def read(level, i):
                chunk, bitmap, ranks = levels[level]  # noqa: B023
                block = i // dac.BLOCK
                bits = bitmap[block * dac.BLOCK // 8 : i // 8 + 1]
                taken.append(len(bits) + 5)  # noqa: B023
                return chunk[i], bits, int(np.frombuffer(ranks, "<u4")[block])

            assert all(dac.get(read, int(i)) == ids[i] for i in rng.integers(0, n, 40 if n else 0))
            assert max(taken, default=0) <= dac.BLOCK // 8 + 5  # bytes of a level that one token needs


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_shards_of_documents(odd, small, nothing, monkeypatch, spark):
    monkeypatch.setattr(dac, "SHARD_IDS", 5000)
    low = -(1 << 63)
    shared = spark.createDataFrame([(low, "least id"), (None, "none"), (4, thue_morse(1024) + " " + thue_morse(1024, "ba")), (4, "b"), (4, "a"), (4, "a")], "doc_id long, text string")
    for docs in (odd, small, shared):
        rows = in_order((r.doc_id, r.text) for r in docs.collect())
        shards = dac.write_shards(docs, BYTE)
        got = sorted(map(tuple, dac.read_digests(shards).collect()), key=lambda r: r[1])
        ids = [x + [2] for x in library(BYTE, [t for _, t in rows])]
        crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
        # rows that share an id may stand in either order; ids, places and contents otherwise
        assert [r[0] for r in got] == [i for i, _ in rows] and sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(((i, len(x), c) for (i, _), x, c in zip(rows, ids, crc, strict=True)), key=str)
        assert [r[1] for r in got] == np.append(0, np.cumsum([r[2] for r in got]))[:-1].tolist()
        if docs is small:
            assert got == [(i, int(s), len(x), c) for (i, _), s, x, c in zip(rows, np.append(0, np.cumsum([len(x) for x in ids])), ids, crc)]
            for at in (7, 100):
                assert [dac.token_at(shards, rows[at][0], k) for k in (0, 5, len(ids[at]) - 1)] == [ids[at][k] for k in (0, 5, -1)]
            assert dac.token_at(shards, rows[7][0], 10**9) is None and dac.token_at(shards, -5, 0) is None
    again = dac.read_digests(dac.write_shards(shared.repartition(3), BYTE))
    assert sorted(map(tuple, again.collect()), key=lambda r: r[1]) == got  # the order of ties is fixed
    assert dac.read_digests(dac.write_shards(nothing, BYTE)).count() == 0


def test_one_token_reads_few_pages(small):
    import glob

    import pyarrow.parquet as pq

    shards = dac.write_shards(small.filter("text is not null"), BYTE)
    files = glob.glob(textkit._stored[-1].removeprefix("file://") + "/*.parquet")
    for file in files:
        column = pq.ParquetFile(file).metadata.row_group(0).column(9)
        assert column.compression == "UNCOMPRESSED" and column.path_in_schema == "c0"
    plan = shards.filter("part = 1 and shard = 0").select("c1")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<part:int,shard:bigint,c1:binary>" in plan and "EqualTo(shard,0)" in plan
