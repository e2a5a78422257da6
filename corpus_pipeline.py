"""From raw documents to packed training sequences.

Stages, each over all that the one before kept: quality rules, near-duplicate removal
(one document of each group stays), removal of passages that an earlier document has,
redaction of secrets, packing.  Every stage but the last returns the columns of
``documents``; ``run`` writes each stage as Parquet to the shared folder and rereads it.

Defined results: null, empty and short texts fail the quality rules and go; rows that share
an id are one document to the near-duplicate stages, and stay or go together; rows with a
null id are copies of nothing and reach the packing; an empty table gives no rows; columns
beside doc_id and text are carried up to the packing, which returns its own; texts of any
length are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import minhash_dedup, packing, secret_scan, substring_dedup, suffix_quality
from lodestone.llm.common import bounded_broadcast, cut, scratch
from lodestone.llm.queries import tokenizer_path

#: Ids that are broadcast at most, behind a count.
FEW_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less those whose doc_id is in ``gone``."""
    return docs.join(bounded_broadcast(cut(gone.select("doc_id").distinct()), FEW_IDS), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, minhash_dedup.near_duplicates(docs, width=5, percent=80).filter(~F.col("kept")))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(docs, substring_dedup.passages(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.train(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", passage_dedup),
    ("secret_scans", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch(spark) as steps:
            docs = steps.keep(stage(spark, docs, sf_dir))
    return docs


#: Suffix arrays, MinHash groups and learnt scores have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None
