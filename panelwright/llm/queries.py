"""Registered queries: each applies one operator, with its usual parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import (
    audit, jaccard, language, lines, mixing, neighbours, packing, quality, quotes, spelling, suffixes, token_counts, toxicity,
)
from panelwright.llm.stored import small_batches

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.thread(_table(spark, sf_dir, "conversations"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted(_table(spark, sf_dir, "documents")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_nearest_neighbours, op3_suffix_dedup, op4_source_mixing, op5_best_fit_packing,
        op6_toxicity, op7_language_id, op8_ngram_jaccard, op9_chat_quotes, op10_token_counts,
        op11_filter_audit, op12_spelling_variants, op13_line_dedup,
    )
}

ORACLES = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op4_source_mixing": mixing.ORACLE_SQL,
    "op8_ngram_jaccard": jaccard.ORACLE_SQL,
    "op11_filter_audit": audit.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
    "op13_line_dedup": lines.ORACLE_SQL,
}


# The stages of corpus_pipeline.py: (spark, docs, sf_dir) -> DataFrame. Ids may be null or repeat, texts may be null,
# empty or very long, and rows may repeat; columns whose names clash with inner ones are kept as they are. An
# empty table gives an empty result.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels, gives a score below one half.

    A null, empty or letterless text has the score of the bias alone, below one half where most labels are clean.
    Repeated rows get equal scores, so all of them stay or go. Without labels every document stays.
    """
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model).filter("__score < 0.5").drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8.

    The smallest id of a group stays, a null one only if all are null; of rows that repeat id and text one stays.
    Null and empty texts, and those without words, are copies of nothing and stay.
    """
    small_batches(spark)
    return jaccard.one_of_each(docs, size=5, percent=80)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that start twice; n_chars is counted anew.

    Null texts stay null with null n_chars, short ones stay as they are, texts that repeat whole become empty.
    Where a cut leaves a part of a character, that goes too.
    """
    small_batches(spark)
    return suffixes.clean(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken, three times at most.

    Documents without words, null and empty texts among them, have size 0 and no part in the mix. A null source
    is a source of its own. Rows that repeat are taken as documents of their own.
    """
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    A null or empty text is a piece with the end id only. Each row is packed by itself, whatever its id.
    """
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))
