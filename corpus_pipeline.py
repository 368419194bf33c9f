"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes what its predecessor kept, as documents; the last one gives the packed pieces. A
stage's result is written as Parquet and read again, so a lost executor costs no earlier stage.
Nulls, empty texts, repeated rows and empty tables: see the operators, whose rules hold here."""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import packing, pii, quality, simhash, substrings
from lodestrata.llm.common import store, table

#: The session's setting that holds the secret key of the pseudonyms.
KEY_SETTING = "spark.lodestrata.pii.key"


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where documents have that column."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier passage go; the rest of a text stays as it is."""
    return _counted(substrings.strip_repeats(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms, by the key of the setting KEY_SETTING."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms are made with a public key and can be undone by anyone", stacklevel=2)
    return _counted(pii.mask(docs, key.encode() if key is not None else pii.EXAMPLE_KEY))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their sequence and place."""
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("pii_pseudonyms", pii_stage),
    ("best_fit_packing", packing_stage),
]
#: Not expressible in SQL: the label model, fingerprints and tokens. tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, name)
    return docs
