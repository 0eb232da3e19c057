"""A training-corpus pipeline of five stages; every stage is written as a table and read again by the next.

Every stage takes an empty table, texts of any length, and further columns of any name, which it drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvox.llm.common import discard, documents, stored
from sparvox.llm.linededup import dedup_lines
from sparvox.llm.mixing import mix
from sparvox.llm.packing import pack_documents
from sparvox.llm.quality import fit, score
from sparvox.llm.simhash import one_of_each

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labelled ones among them, does not reject. Null and empty texts are
    scored as empty ones, repeated rows and null doc_ids one by one."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select(*COLUMNS), model).where("score >= 0.3").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the first document that holds them (a null doc_id is last); n_chars follows the text. No row goes, even if its text does."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: fingerprints within 3 bits, or 0.8 of their five-word shingles in common.

    It is that of the smallest doc_id, null last; texts under one doc_id, or none, are told apart, and repeated rows are one."""
    return one_of_each(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them. A null source is one of its own; texts without words have no size, and
    are taken at their source's rate all the same."""
    return mix(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences; repeated rows are packed one by one, empty texts as an end token."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near), ("mixing", mixing), ("packing", packing)]

#: Compression, SimHash components and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. Each stage's rows are a table, deleted once the next stage's is written."""
    docs, before = documents(spark, sf_dir), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
