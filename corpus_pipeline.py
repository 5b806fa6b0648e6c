"""From raw documents to a training order, in five stages; each works on all rows the one before it kept.

Every stage takes null and empty texts, null ids and sources, repeated rows, empty tables and further columns of
any name, and says in its operator what becomes of them: the classifier scores a text without words by its bias,
near-duplicates counts all texts without words, and rows that repeat, as one group, no text without words is
contaminated or holds a secret, and the mix takes nothing of it, so it stands last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm import decontamination, mixing, quality_classifier, secrets, simhash_dedup
from wayspark.llm.common import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the quality classifier, fitted on the labels outside the held-out fifth, scores under its threshold."""
    model = quality_classifier.fit(docs, quality_classifier.learnable(table(spark, sf_dir, "labels")))
    return quality_classifier.keep_good(docs, model)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group whose five-word shingles are 0.8 or more alike."""
    return simhash_dedup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; no document goes."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum: a row for each epoch of a document, in training order; documents not taken stand last. ``text_file`` is the
    Parquet file that holds the document as it came here, its text masked (empty if ``docs`` isn't read from files)."""
    return mixing.curriculum(docs.withColumn("text_file", F.input_file_name()), carry=("text_file",))


STAGES = [
    ("quality classifier", good),
    ("near-duplicates", unlike),
    ("decontamination", clean),
    ("secret scans", masked),
    ("mixing", mixed),
]

#: Training and fingerprints are not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a Parquet table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i + 1}")
    return docs
