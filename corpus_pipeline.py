"""A corpus pipeline of five of the operators: quality, near-duplicates, secrets, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, quality, secrets, simhash
from tidemark.llm.common import new_folder, prepare, read, remove, trainable


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score reaches 0.7; learns from labels of documents that aren't held out."""
    prepare(spark)
    model = quality.train(docs, read(spark, sf_dir, "labels"), trainable())
    return quality.keep(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: the one of least id."""
    return simhash.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows."""
    return secrets.redacted_rows(docs, secrets.train(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents repeated or left out, one a source cut where its share ends."""
    return mixing.mixed_rows(docs, mixing.mix(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mix_stage),
    ("byte-level BPE encoding and decoding", tokens_stage),
]

#: The classifier and the redaction are learned, so SQL can't express the pipeline; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written to the shared folder and read again.

    What a stage has read is removed when its own result is complete; the last result stays.
    """
    docs, folder = read(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
