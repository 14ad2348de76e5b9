"""The corpus pipeline: documents in, token ids of the clean and distinct ones out.

Each stage works on all documents that its predecessor kept. Stages are written as Parquet in the shared folder and
read again, so a lost executor never costs more than the running stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.llm import bpe, decontam, langid, minhash
from cloudgauge.llm.common import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: texts without a letter and null texts go."""
    model = langid.train(docs)
    aside = {c: f"_own_{c}" for c in ("lang_pred", "score")}  # columns of the documents, not the prediction
    found = langid.identify(docs.withColumnsRenamed(aside), model).filter(f"lang_pred <> '{langid.UNDETERMINED}'")
    return found.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of at least 0.8."""
    return minhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language), ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks), ("bpe", encode_texts)]

#: SQL can express neither naive Bayes scores nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for _, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs
