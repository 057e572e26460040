"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared
folder and reads again as the next stage's docs. All stages but the last return the columns of documents.

Defined cases: documents without a text, or with fewer than 20 words, go in the first stage, so null, empty and blank
texts reach no other; null languages, sources and ids are values of their own (of equal texts a row with an id stays
before one without); of rows repeated in every column one stays; very long texts pass whole; columns beside those of
documents are carried through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credenza.llm import jaccard_join, mixing, quality_rules, sentencepiece_codec, suffix_dedup
from credenza.llm.common import save
from credenza.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each component of similar documents."""
    return jaccard_join.first_of_class(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur earlier; n_chars follows the text."""
    return suffix_dedup.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it (0 to 3 times)."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mixture: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixture),
    ("sentencepiece", tokens),
]

#: SQL can't express the encoder, nor the estimates and passages before it; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
