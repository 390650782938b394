"""From raw documents to token ids: filter, deduplicate, mix and encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, line_dedup, mixing, ngram_join, quality
from gaugeworks.llm.common import prepare, remove, written
from gaugeworks.llm.queries import VOCABULARY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (operator 6): documents that the base limits or the outlier estimate reject go."""
    prepare(spark)
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (operator 1): a line that several documents share stays in the smallest one; ``n_chars`` follows."""
    found = line_dedup.dedup_lines(docs, counts=False)
    return found.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else found


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (operator 5), five words and 0.8: of a group, the smallest document stays."""
    return ngram_join.one_of_each(docs, words=5, similarity=(4, 5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights (operator 9): a document taken twice is there twice."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding (operator 7): token numbers and digests per row."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Outlier estimates and token ids can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again as the next one's input.

    A stage's input is deleted when its own result is written; the last result stays for the caller.
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        result = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            remove(docs)
        docs = result
    return docs
