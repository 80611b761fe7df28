"""A corpus cleaned in stages, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.

A classifier, a connected-component search and a tokenizer are not
expressible in SQL, so ``ORACLE_SQL`` is None; ``tests/llm`` holds the stages
against brute-force versions.

Every stage takes null ids, texts and other columns, texts of any length,
repeated rows and empty tables, and passes on columns it doesn't know, whatever
their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, crf, decontam, neardup, quality
from lectern.llm.common import materialise

#: Documents whose score is below this are rejected.
MIN_SCORE = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, from hosts that do.

    Null and empty texts go, having too few words; a null source is no host, so
    its documents are judged by themselves; repeated rows are judged each.
    """
    return quality.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sufficient quality; the classifier learns from what came through.

    Null texts are scored as empty ones and null ids as others; rows without a
    label, or with a null one, are not learned from; equal texts score alike;
    without labels of both classes every score is the base rate.
    """
    model = crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return crf.score_table(docs, model, keep_columns=True).where(F.col("_score") >= MIN_SCORE).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id.

    Texts without words are no one's copies and all stay; of rows of one id and
    text one stays; a null id is chosen only where the class has no other; an id
    of several texts loses only the copies among them.
    """
    return neardup.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No contaminated documents, and no benchmark passage in the others.

    Null texts and texts without words stay as they are; without items all stay;
    repeated rows are judged each.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes.

    Null texts count as empty and have no ids; every row has its result.
    """
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
