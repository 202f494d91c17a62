"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All stages
but the last return the columns of `documents`. Null texts, empty texts and repeated rows are handled
as each operator's docstring says; an empty table passes through as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm import decontaminate, pieces, pseudonyms, simhash, toxicity
from lumenreel.llm.common import columns_of, ensure_checkpoint_dir, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from those of `docs` that are labelled."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.remove_toxic(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each SimHash component."""
    return simhash.keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with format-preserving pseudonyms in their texts; n_chars follows the new text."""
    moved = pseudonyms.pseudonymise(docs, report=False)
    if "n_chars" in docs.columns:
        moved = moved.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars"))
    return moved.select(*columns_of(moved, docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact) of each document."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("pii", hide_personal_data),
    ("sentencepiece", encode_pieces),
]

#: Models and fingerprints are beyond SQL; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
