"""The corpus pipeline: stages over documents, each written and read again before the next.

Columns beyond those of ``documents`` stay, whatever their names, up to the last
stage, which returns pieces. An empty table goes through as one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkwarden.llm import dedup, jaccard, mixing, packing, quality
from inkwarden.llm.common import remove, shared_folder, table


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null text counts as empty and is judged as such, null sources and languages are
    sites of their own, repeated rows go or stay together, long texts are read whole.
    """
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays.

    Null text equals empty text; a null id is smaller than any; of rows that are the same
    in id and text one stays; long texts are compared by SHA-256.
    """
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at a similarity of 0.8 the one with the smallest id stays.

    Texts without a word stay; a null id comes after any; ties in id go by a hash of the
    text; rows that are the same in id and text go or stay together.
    """
    return jaccard.drop_near_copies(docs, size=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target asks for.

    Texts without a word are taken no times; null is a source; a repeated row is a document
    of its own; the document on the cut comes once more if half of it or more is wanted.
    """
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null text is a closing id alone; repeated documents are packed as often as they come;
    long texts are cut; null sources share a queue; null ids stay null.
    """
    return packing.digested(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", drop_poor), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Classifier, shingle links and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's folder goes when the next is written, the last one when the driver ends."""
    docs = table(spark, sf_dir, "documents")
    remove(spark, top := f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", now=False)
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{top}/{k}-{name}")
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
