"""Corpus pipeline: documents in, token files out.

``STAGES`` are applied in order; each takes ``(spark, docs, sf_dir)``, works on
everything its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import decontaminate, jaccard, mixing, tokenfile, toxicity
from treeline.llm.common import scratch, table, tokenizer_json
from treeline.session import write_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents more likely toxic than not go."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, toxicity.severity_grades(docs, labels))
    return toxicity.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each class of near copies stays."""
    return jaccard.dedupe(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents as often as their source's weight draws them."""
    return mixing.mix(docs).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token files in the shared folder; returns what they hold per document."""
    path = scratch(spark, "corpus-tokens")
    tokenfile.write(docs, path, tokenizer_json())
    return tokenfile.digests(spark, path)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"pipeline-{name}")
    return docs


#: Trained model, tokenizer and entropy coder: not expressible in SQL.
ORACLE_SQL = None
