"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import common as C
from thicket.llm import minhash_dedup, packing, quality, secret_scan, substring_dedup

#: Learned models can't be written in SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def _key(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _without(docs: DataFrame, told: DataFrame, gone) -> DataFrame:
    """docs without the rows that ``told`` (doc_id, text_key, ..) marks by ``gone``; rows with a null id stay."""
    marked = told.where(gone).select(F.col("doc_id").alias("i_"), F.col("text_key").alias("k_")).distinct()
    return docs.join(marked, (F.col("doc_id").cast("long") == F.col("i_")) & (_key() == F.col("k_")), "left_anti").select(*docs.columns)


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.3)."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    scored = quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
    return _without(docs, scored, F.col("predicted") == 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least id (five-word shingles, 0.8), one row of a repeated row."""
    told = minhash_dedup.near_duplicates(docs).checkpoint()
    again = told.where("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("n_")).where("n_ > 1").select(F.col("doc_id").alias("i_"), F.col("text_key").alias("k_"))
    once = docs.join(again, (F.col("doc_id").cast("long") == F.col("i_")) & (_key() == F.col("k_"))).dropDuplicates(["i_", "k_"]).select(*docs.columns)
    marked = told.join(again, (F.col("doc_id") == F.col("i_")) & (F.col("text_key") == F.col("k_")), "left")
    return _without(docs, marked, ~F.col("kept") | F.col("i_").isNotNull()).unionByName(once)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that occur earlier; others' texts are unchanged."""
    done = substring_dedup.remove_repeated_windows(docs)
    return _with_text(done.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the secrets found in them masked."""
    return _with_text(secret_scan.redact(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; tables between them lie in the shared checkpoint folder until the end."""
    C.prepare(spark)
    folder = f"{C.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, (name, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            if k == len(STAGES) - 1:
                return out.checkpoint()
            out.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    finally:
        C.remove(spark, folder)
