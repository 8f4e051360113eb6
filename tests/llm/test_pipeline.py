"""The pipeline against plain Python over its stages, and on odd and empty tables."""

import collections

import corpus_pipeline
import pytest

from strandline.llm import langid
from strandline.llm.queries import MIX_SEED
from tests.llm.conftest import SF
from tests.llm.test_nearjoin import brute_roots
from tests.llm.test_rules_media_mix import brute_mix, brute_rules
from tests.llm.test_tokens import expected_digests


def plain(spark, rows, schema):
    """All stages in plain Python; only the language model comes from the code under test (its answers are checked in test_classifiers)."""
    rows = [r for r in rows if brute_rules(r.text)[-1]]
    model = langid.fit(spark.createDataFrame(rows, schema).filter(langid.remainder(5) != 0))
    rows = [r for r, ok in zip(rows, langid.answers(model, [r.text.encode() for r in rows])[2], strict=True) if ok]
    kept = {}
    for n, root in enumerate(brute_roots([r.text for r in rows])):
        best = kept.get(root)
        if best is None or (rows[n].doc_id is None, rows[n].doc_id or 0) < (rows[best].doc_id is None, rows[best].doc_id or 0):
            kept[root] = n
    rows = [rows[n] for n in sorted(kept.values())]
    n = collections.Counter(r.source for r in rows)
    copies = brute_mix([(r.doc_id, r.source, r.text) for r in rows], {s: k**0.5 for s, k in n.items()}, len(rows), MIX_SEED, by_row=True)
    return expected_digests([(r.doc_id, r.text) for r, k in zip(rows, copies, strict=True) for _ in range(k)])


def test_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 2500")
    path = str(tmp_path / "sf")
    docs.write.parquet(path + "/documents.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, path).collect()), key=str)
    assert got == plain(spark, docs.collect(), docs.schema) and len(got) > 50


def test_rows_without_or_with_shared_ids(spark, tmp_path):
    """No clean row is lost for its id, source, neighbours or language label."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 300 and 2500")
    rows = [r for r in docs.orderBy("doc_id").collect() if brute_rules(r.text)[-1]][:40]
    odd = [(None if n % 4 == 0 else 7 if n % 4 == 1 else r.doc_id, r.text, r.lang if n % 5 else None, None if n % 3 == 0 else r.source, r.n_chars) for n, r in enumerate(rows)]
    odd += [odd[2], odd[3], (None, None, None, None, None), (1, "", "", "", 0), (2, "too few words", "en", "a", 1)]
    path = str(tmp_path / "sf")
    docs = spark.createDataFrame(odd, docs.schema)
    docs.write.parquet(path + "/documents.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, path).collect()), key=str)
    want = plain(spark, docs.collect(), docs.schema)
    assert got == want and any(r[0] is None for r in got) and len({r[2] for r in got if r[0] == 7}) > 3


@pytest.mark.parametrize("empty", [True, False])
def test_odd_tables(spark, odd, tmp_path, empty):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([] if empty else [(r.doc_id, r.text, r.lang, r.source, len(r.text or "")) for r in odd.collect()], schema)
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, now, "").write.parquet(path)
        now = spark.read.parquet(path)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert now.columns == docs.columns
    assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if empty:
        assert now.count() == 0
    else:
        rows = [r for r in docs.collect() if r.doc_id not in (8, 10)]  # thousands of equal words: rejected, and too long for brute force
        assert sorted(map(tuple, now.collect()), key=str) == plain(spark, rows, docs.schema)


def test_names_that_operators_use_inside(spark, tmp_path):
    """Columns named like those that stages make or add come back unchanged, row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 300 and 2500").limit(80)
    names = ["_key", "_node", "_no_id", "copy", "rate", "_row", "__id", "row", "node", "tie", "kept", "words", "key"]
    rows = [(*r, *(f"{n}{r.doc_id}" for n in names)) for r in docs.collect()]
    rows += rows[:5]
    schema = docs.schema
    for n in names:
        schema = schema.add(n, "string")
    now, plain_docs = spark.createDataFrame(rows, schema), docs.unionByName(docs.limit(0))
    allowed = set(rows)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / str(k))
        stage(spark, now, "").write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == plain_docs.columns + names and set(map(tuple, now.collect())) <= allowed and now.count()
    bare = spark.createDataFrame([r[: len(docs.columns)] for r in rows], docs.schema)
    one = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, bare, "").collect())
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), "").collect()) == one
