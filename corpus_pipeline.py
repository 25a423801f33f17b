"""The corpus pipeline: toxic documents go, of near-duplicates one stays, personal data is replaced, the sources are
mixed to their target weights, and what is left becomes token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next
stage's docs. All but the last return the columns of documents, also further columns of any name, unchanged but for what
the stage says. A table without rows gives one without rows in each stage; texts of any length are read whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sigframe.llm import op3_pii, op4_toxicity, op5_jaccard, op6_mixing, op7_bpe
from sigframe.llm.common import read
from sigframe.signal import shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a lexicon learned from the labels outside the held-out fold. Null and
    empty texts have no hits and stay; repeated rows go or stay together; a null doc_id has no label."""
    return op4_toxicity.keep_clean(docs, op4_toxicity.learn(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group with a Jaccard similarity of 0.8 or more on runs of five words. Null texts and
    texts without words are in no group and stay; of repeated rows one stays; a null doc_id comes first, and texts that
    share a doc_id are ordered by a hash."""
    return op5_jaccard.distinct_documents(docs, words=5, num=4, den=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced. Null texts stay null; repeated rows each
    stay, and count once in the statistics."""
    return op3_pii.sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and what the mix takes of it besides. Null texts and texts
    without words have nothing to take and go; repeated rows are documents of their own; a null source is a source, the
    last one."""
    return op6_mixing.sampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their digests of each document; of a null text those of the empty one. Repeated rows each get
    a row."""
    return op7_bpe.tokenize(docs, public_tokenizers.path(op7_bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixing), ("tokens", tokens)]

#: Two stages learn or cluster beyond what SQL expresses; a brute-force version tests the run instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stands between them is in the shared folder of the session."""
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{i}")
        docs = spark.read.parquet(f"{where}/{i}")
    return docs
