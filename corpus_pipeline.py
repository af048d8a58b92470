"""The corpus pipeline: quality, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.kneser_ney import keep_quality
from strandline.llm.line_dedup import drop_duplicate_lines
from strandline.llm.mixing import mix_documents
from strandline.llm.packing import pack_power_of_two
from strandline.llm.queries import TOKENIZER
from strandline.llm.scratch import Scratch, made_within
from strandline.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are kept, and so are all without trusted labels.
    """
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, but for a word, go.

    Null texts and texts without words have no lines and are kept; documents left
    without a word by the lines that they lose are gone.
    """
    return drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more.

    Covering LSH of SimHash fingerprints links first, prefix keys find what is further apart; all links are verified.
    Null texts and texts without words are one group; equal rows are near copies.
    """
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source; documents without words come once.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each a sequence. A null or empty text gives its end id alone."""
    return pack_power_of_two(docs, TOKENIZER)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Near duplicates, trained models and token ids are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next.

    What a stage's operator saved meanwhile is deleted once its rows are written.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with made_within():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
