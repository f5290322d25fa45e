"""Corpus pipeline: documents that the quality classifier and rules keep, one of each group of near copies, packed.

Each stage takes what its predecessor kept, written as Parquet and read again.

Null texts count as empty and go at the rules (no words); rows without an id are judged
like others and never grouped; rows that repeat get one verdict, of equal ones under one
id the third stage keeps one, and rows that share an id but not their text are told
apart; texts may have any length; extra columns pass through, whatever their names, up
to the last stage; an empty table gives an empty table, and so does every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import ngram_join, packing, quality_classifier, quality_rules
from quarry.llm.common import table
from quarry.llm.queries import JSON_VOCABULARY
from quarry.session import write_table


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among ``docs``, scores 0.3 or more."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds of their language and source."""
    return quality_rules.keep_good(docs)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by five-word shingles at 0.75."""
    return ngram_join.keep_one_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, JSON_VOCABULARY, public_tokenizers.PATTERN)


STAGES = [("quality_classifier", quality_classifier_stage), ("quality_rules", quality_rules_stage),
          ("ngram_jaccard", ngram_jaccard_stage), ("packing", packing_stage)]

#: A trained classifier and a tokenizer are not SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
