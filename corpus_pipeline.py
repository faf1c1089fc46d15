"""Training-data pipeline over ``documents``: five stages, each through one operator of
``insightframe.llm`` and each on all that the stage before it kept.

quality: rows that the quality classifier scores below 0.5 go. near_dedup: of each group of
near duplicates (five-word shingles, similarity of 0.8 or more) the least doc_id stays.
decontaminate: documents that hold a benchmark item go. secrets: every secret found, linked weak
parts included, is masked. packing: the documents are packed into sequences of 2048 tokens.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from insightframe.llm import decontaminate, near_dedup, packing, quality_gbt, secret_scan
from insightframe.llm.common import fold_of, forget, materialise, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier scores 0.5 or more; it learns from labelled rows of ``docs``.

    NULL and empty texts are scored as texts without bytes, NULL ids like others, repeated rows
    each; all columns stay; an empty table gives an empty result.
    """
    model = quality_gbt.fit_quality(docs, read(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    return quality_gbt.keep_quality(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates.

    NULL and empty texts and NULL ids all stay, but for repeated rows of one id and text; unlike
    texts of one id are judged each by its own; all columns stay; an empty table gives an empty
    result.
    """
    return near_dedup.keep_one(docs, words=5, per_cent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item.

    NULL and empty texts hold none; NULL ids and repeated rows are judged each; all columns stay; an
    empty table gives an empty result.
    """
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, secrets masked.

    NULL texts stay NULL and empty ones empty; repeated rows are each masked; all columns stay,
    ``n_chars`` with the new length; an empty table gives an empty result.
    """
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences, columns of their own.

    NULL and empty texts are one token, their end; NULL ids and repeated rows are packed each; an
    empty table gives an empty result.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", dedup), ("decontaminate", clean), ("secrets", mask), ("packing", pack)]
# trained trees, a latent space and a tokenizer's ids: tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces.

    What stages do with NULL, empty and repeated rows and with extra columns is theirs to say; each
    stage's rows are written once, and deleted when the next stage's are.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
