"""The corpus pipeline: stages over documents, each written and read again.

Quality rules, SimHash near-dedup, substring dedup, secret scans, packing. All
but the last keep the columns of documents. Stages 1 and 2 drop documents, stage 3
removes repeated words (and documents with no word left), stage 4 replaces
secrets, stage 5 gives the packed pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import packing, quality, secrets, simhash, substring
from barloom.llm.common import BLANKS, scratch, stored

CAPACITIES = [512, 1024, 2048, 4096]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cut(docs).where(F.btrim("text", F.lit(BLANKS)) != "")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.by_words(docs), CAPACITIES)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing)]
#: Fingerprints and components are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), result=True)
    return docs
