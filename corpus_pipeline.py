"""Corpus pipeline: stages over `documents`, each applying one operator of `quillflow.llm`.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillflow.llm import bpe, lines, mixing, neargroups, toxicity
from quillflow.llm.queries import tokenizer
from quillflow.llm.stored import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels`, does not reject."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document less the lines that stand earlier, exactly or within one edit; n_chars follows the text."""
    less = lines.dedup_lines(docs)
    return less.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those linked by a similarity of 0.8 or more of their five-word shingles."""
    return neargroups.one_of_each(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 3, 1, 2 over 150 % of the words; a document occurs as often as it is taken, at most twice."""
    return mixing.mix(docs, F.array("source"), weights=(3, 1, 2), share=1.5, repeats=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes they decode to."""
    return bpe.digest(docs, tokenizer("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]
#: Training, edit distances and BPE are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a written table before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
