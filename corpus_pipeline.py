"""Documents to training tokens: five stages, each a training-data operator on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined cases, for every stage: an empty table gives no rows; a null text counts as empty, and texts of any length
are taken whole; null ids come last where the smallest id decides, and rows with null ids are documents like others;
of rows repeated whole one stays from the second stage on; further columns go through the stages untouched,
whatever their names; ties are decided by id and text, so a run's result does not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import bpe, exact_dedup, mixing, quality, simhash
from tracksmith.llm.common import fresh
from tracksmith.llm.queries import crc_mod

#: Documents scored below this go. The part of all tokens that the mixture keeps, and how far it flattens the margins.
LEAST_QUALITY = 0.5
KEEP = 0.9
SMOOTHING = {"source": 0.9, "lang": 0.9, "topic": 0.9}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (without labels to learn from, all); it learns from labelled rows whose CRC-32 of the id is not 1 modulo 3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels, usable=crc_mod("doc_id", 3) != 1)
    (score,) = fresh(docs, "score__")
    return quality.scores(docs, model, name=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, but for white space, the one with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of three-word shingles, linked at 3 bits or fewer, as op5 has it."""
    return simhash.drop_near_duplicates(docs, shingle=3)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn towards raked weights of source, language and topic."""
    return mixing.sample(docs, keep=KEEP, smoothing=SMOOTHING)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256, of the text that the ids decode to, of every document left: encoded by chunks and decoded, as op3 has it."""
    return bpe.encode(docs, outputs=("ids", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", mixture),
    ("BPE encoding", token_ids),
]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
