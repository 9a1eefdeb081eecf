"""The registered corpus queries: one thin query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("text_key")


def _remainder(k: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(k))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _remainder(5) == 0).drop("text_key")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_and_decode

    done = encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE, find_secrets, listed

    found = find_secrets(_table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in BASE]
    live = F.size(F.filter("base", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"), live)


def op6_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_next

    return compare_with_next(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated_windows

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"), _remainder(4) == 2)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    packed = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
