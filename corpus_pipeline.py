"""A training corpus from raw documents in five stages, each written as Parquet and read again.

Toxic documents go, boilerplate lines of a source go, of near duplicates the
smallest doc_id stays, the sources are mixed to their weights (a document can
occur twice or not at all), and what remains is encoded by BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bpe, line_dedup, mixing, simhash, toxicity
from tracewell.llm.common import in_fold, park, table
from tracewell.llm.queries import tokenizer_path
from tracewell.storage import delete, new_path, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), keep=~in_fold("doc_id", 4, 2))
    return toxicity.drop_toxic(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_document_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage parks goes when its result is written, and that result when the next one is; only the last stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = park(stage(spark, docs, sf_dir), name, path)
        if before:
            delete(spark, before)
        before = path
    return docs
