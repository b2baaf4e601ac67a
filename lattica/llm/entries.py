"""Queries of this subpackage, as ``__spark_entry__`` registers them, and their DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import chat, fingerprint, langid, mixing, ngram_join, packing, pii, quality, toxicity, urls
from lattica.llm._common import table

Query = Callable[[SparkSession, str], DataFrame]


def _fold(mod: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod


#: Target shares of the registered mix: sources flattened (power 0.5), languages and forms by name; 0.01 is left for
#: other languages and none (where the table has no such documents the named shares take it all).
MIX = {"source": 0.5, "lang": {"en": 0.49, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": {"prose": 0.9, "table": 0.02}}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"), MIX)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.where(_fold(5) != 0)
    found = toxicity.score(docs, toxicity.fit(docs, learn))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return found.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"), "n_windows", "n_toxic")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept", "char_distance", "word_distance")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(F.coalesce(_fold(4) != 2, F.lit(True))))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_id")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_chat_format": op2_chat_format,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_fingerprint": op5_fingerprint,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_url_filters": op10_url_filters,
}

SQL: dict[str, str] = {
    "op2_chat_format": chat.SQL,
    "op10_url_filters": urls.sql(),
}
