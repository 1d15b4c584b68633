"""A training-corpus pipeline: STAGES applied in turn to ``documents``, each one's result written and read by the next.

Cases that every stage defines: a null text counts as empty; rows without id are rows like any other, and are near duplicates of
nothing; rows that repeat an id or a whole row are judged one by one, except that near-dedup keeps one of linked texts and one of
repeated rows; ties go to the least id; texts of any length are read as a whole; columns beside ``doc_id`` and ``text`` pass
through unread, whatever their names; an empty table gives an empty result, and without labels or benchmark items the stages that
use them drop nothing. Each stage's docstring says what that means for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reuselens.llm import decontamination, near_dedup, quality_classifier, quality_rules, sentencepiece_bpe
from reuselens.llm.common import staged, table
from reuselens.llm.queries import tokenizer_path
from reuselens.plans.shipping import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier, trained on the table's labels, scores below 0.5.

    Empty texts have a score like any others. Without labels nothing is dropped; with labels of one class all rows get that class."""
    ship(spark)
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the default quality policy rejects, empty texts among it (fewer than 50 words)."""
    ship(spark)
    return quality_rules.keep(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate group (five words, similarity of 0.8 or more).

    Of repeated rows one stays; unlike texts of one id all stay; rows without id, and texts without words under different ids, all
    stay."""
    ship(spark)
    return near_dedup.keep(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item, however long they are. Empty texts and items hold none."""
    ship(spark)
    return decontamination.keep(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left, a row for each row; an empty text has two tokens."""
    ship(spark)
    return sentencepiece_bpe.digests(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("sentencepiece", tokenize),
]

#: The classifier is trained and the tokenizer is a library's, so SQL can't express the rows; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
