"""The corpus pipeline: quality rules, language ID, near-duplicate join, source mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and reread as
the next stage's docs.  All but the last return the columns of documents.

Edge cases: as in the operators.  The first stage drops null, empty and very short texts; the second
drops texts without a letter or without an accepted language; of repeated rows one stays in the third;
an empty table gives an empty table at every stage.  Other columns pass through
whatever their names, which may be those that operators use inside or add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, langid, mixing, nearjoin, repeats
from strandline.llm.queries import MIX_SEED, tokenizer
from strandline.llm.textkit import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the repetition rules keep."""
    return repeats.keep_rows(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; it learns from a bounded sample of these documents."""
    return langid.keep_rows(docs, langid.fit(docs.filter(langid.remainder(5) != 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return nearjoin.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that sources weigh as the square root of their size; copies are repeated rows."""
    return mixing.mixed_rows(docs, mixing.root_weights(docs), seed=MIX_SEED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every copy."""
    return bpe.encode_digests(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("source mixing", source_mix), ("BPE", encode)]

#: The language and BPE stages are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
