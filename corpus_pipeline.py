"""Corpus pipeline: from raw documents to token files.

Each stage takes what the stage before kept.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terranet.llm import decontaminate, labelled, line_crf, mixture, near, token_file
from terranet.llm.tables import read
from terranet.plans.scratch import cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, does not reject."""
    model = line_crf.train(labelled.sample(docs, read(spark, sf_dir, "labels"), "quality", line_crf.FOLDS, line_crf.FOLD, line_crf.SAMPLE))
    return line_crf.good_documents(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more connect."""
    return near.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight: documents may be taken twice, in part or not at all."""
    return mixture.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in its shuffled order, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_file.encoded_documents(docs, by_id=False)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", mix),
    ("token-ID output", tokens),
]
ORACLE_SQL = None  # classifier, MinHash and tokenizer are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
