"""The queries opN_<name> over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, dac, hardneg, katz, langid, licenses, media, mixing, nearjoin, postings, ranking, repeats, spelling
from .textkit import clear_stored  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(documents(spark, sf_dir))


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repetition_rules(documents(spark, sf_dir)).drop("longest_repeat")  # SQL checks it through kept


def op3_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    mixed = mixing.poisson_mix(docs, mixing.root_weights(docs), seed=MIX_SEED)
    return mixed.withColumn("rate", F.round("rate", 9))


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_digests(dac.write_shards(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json")))


def op6_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(documents(spark, sf_dir))


def op8_pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.quality_of(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_packed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


MIX_SEED = 17

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {nearjoin.SHINGLE - 1}], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {nearjoin.SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n_grams, any_value(md5(array_to_string(w, ' '))) AS node FROM grams JOIN d USING (doc_id) GROUP BY doc_id),
nodes AS (SELECT node, min(doc_id) AS rep, count(*) AS copies, any_value(n_grams) AS n FROM sets GROUP BY node),
own AS (SELECT rep, g FROM nodes JOIN grams ON grams.doc_id = nodes.rep),
common AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM own a JOIN own b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
linked AS (SELECT x, y, q.copies AS weight FROM common JOIN nodes p ON p.rep = x JOIN nodes q ON q.rep = y
           WHERE c >= {nearjoin.THRESHOLD} * (p.n + q.n - c) - 1e-9),
reach AS (SELECT rep AS x, rep AS y FROM nodes UNION SELECT reach.x, linked.y FROM reach JOIN linked ON reach.y = linked.x),
cls AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
deg AS (SELECT x, sum(weight) AS n FROM linked GROUP BY x)
SELECT d.doc_id, coalesce(cls.class_id, d.doc_id) AS class_id,
       CAST(coalesce(deg.n, 0) + coalesce(nodes.copies, 1) - 1 AS BIGINT) AS n_links,
       CAST(coalesce(nodes.copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(sets.n_grams, 0) AS BIGINT) AS n_grams
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN nodes USING (node) LEFT JOIN cls ON cls.x = nodes.rep LEFT JOIN deg ON deg.x = nodes.rep
"""

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT doc_id, i,
               CASE WHEN i + {repeats.WINDOW - 1} <= len(w) THEN array_to_string(w[i:i + {repeats.WINDOW - 1}], ' ') END AS a,
               CASE WHEN i + {repeats.MIN_REPEAT - 1} <= len(w) THEN array_to_string(w[i:i + {repeats.MIN_REPEAT - 1}], ' ') END AS b,
               CASE WHEN i + {repeats.MAX_REPEAT} <= len(w) THEN array_to_string(w[i:i + {repeats.MAX_REPEAT}], ' ') END AS c FROM pos),
hit AS (SELECT doc_id, i, a IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a) > 1 AS ra,
               b IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, b) > 1 AS rb,
               c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, c) > 1 AS rc FROM win),
cov AS (SELECT doc_id,
               coalesce(max(CASE WHEN ra THEN i END) OVER (PARTITION BY doc_id ORDER BY i), -999) > i - {repeats.WINDOW} AS ca,
               coalesce(max(CASE WHEN rb THEN i END) OVER (PARTITION BY doc_id ORDER BY i), -999) > i - {repeats.MIN_REPEAT} AS cb, rc FROM hit),
per AS (SELECT doc_id, count_if(ca) AS na, count_if(cb) AS nb, bool_or(rc) AS too_long FROM cov GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(na, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(nb, 0) AS BIGINT) AS covered_words, coalesce(too_long, false) AS too_long
      FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN per USING (doc_id)),
f AS (SELECT *, n_words < {repeats.MIN_WORDS} OR 100 * n_repeat_words > {repeats.MAX_WINDOW_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
       NOT base_failed AND covered_words <= {repeats.MAX_COVERED} * n_words AND NOT too_long AS kept FROM f
"""

_U = "CAST('0x' || substr(md5('{seed}:' || j || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"

OP5_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM n),
p AS (SELECT source, rate, CAST(greatest(ceil(rate / {mixing.PART}), 1) AS INTEGER) AS parts FROM r),
k AS (SELECT source, rate, parts, unnest(range(0, CAST(ceil(rate / parts + 12 * sqrt(rate / parts) + 40) AS BIGINT) + 1)) AS k FROM p),
c AS (SELECT source, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
l AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
u AS (SELECT doc_id, text, source, unnest(range(1, parts + 1)) AS j FROM documents JOIN p USING (source)),
drawn AS (SELECT doc_id, source, CAST(sum(len(list_filter(cdf, lambda x: x <= {_U.format(seed=MIX_SEED)}))) AS BIGINT) AS copies FROM u JOIN l USING (source) GROUP BY doc_id, source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1)) AS copy, round(rate, 9) AS rate
FROM documents JOIN drawn USING (doc_id, source) JOIN p USING (source)
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = f"""
WITH RECURSIVE steps AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
          FROM (SELECT unnest(range(256)) AS n))),
runs AS (SELECT id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
         WHERE length(run) >= {spelling.MIN_LETTERS} GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [195, unicode(ch) - 64] END)) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(b AS BIGINT[])), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, steps),
changed AS (SELECT n, CASE WHEN h % {spelling.DELETE} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= {spelling.MIN_LETTERS} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
at_each AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM at_each),
near AS (SELECT x.word, y.word AS other FROM cut x JOIN cut y USING (i, a, b) WHERE x.word <> y.word
         UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = a || b UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = a || b),
top AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS best, max(o.n) AS best_n FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
told AS (SELECT word, CASE WHEN best_n >= {spelling.FORM_RATIO} * n THEN best END AS form, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN best_n >= {spelling.FORM_RATIO} * n THEN best_n END AS form_n FROM words LEFT JOIN top USING (word)),
chain AS (SELECT word, word AS now FROM told UNION SELECT chain.word, told.form FROM chain JOIN told ON told.word = chain.now WHERE told.form IS NOT NULL)
SELECT t.word, t.form, chain.now AS root, t.n, t.n_near, t.form_n FROM told t JOIN chain USING (word) JOIN told e ON e.word = chain.now WHERE e.form IS NULL
"""

OP12_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({hardneg.SCALE} * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, v.r, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
      FROM v a JOIN v ON a.r <> v.r WHERE a.vec_id % {hardneg.ANCHOR_EVERY} = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS place FROM s WHERE same),
p AS (SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM o WHERE place <= {hardneg.POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.vec_id, s.r) AS rank
      FROM p JOIN s ON p.ar = s.ar WHERE NOT s.same AND {hardneg.LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {hardneg.HIGH} * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {hardneg.NEGATIVES}
"""

_LOW_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOW_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_LOW_WORDS} AS w FROM benchmark),
k AS (SELECT item, least(len(w), {postings.WINDOW}) AS size, w, unnest(range(1, len(w) - least(len(w), {postings.WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM k),
places AS (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size),
hit AS (SELECT r, item, size, i FROM (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM places) JOIN wins USING (size, g)),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids.items, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN ids USING (r)
"""


def queries() -> dict:
    found = [op1_ngram_jaccard, op2_suffix_repetition, op3_iso_media, op4_addressable_codes, op5_poisson_mix, op6_chunk_reuse, op7_katz_backoff, op8_pairwise_ranking, op9_license_paragraphs, op10_subword_language, op11_spelling_variants, op12_packed_negatives, op13_positional_index]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op2_suffix_repetition": OP2_SQL, "op5_poisson_mix": OP5_SQL, "op9_license_paragraphs": licenses.scan_sql(), "op11_spelling_variants": OP11_SQL, "op12_packed_negatives": OP12_SQL, "op13_positional_index": OP13_SQL}
