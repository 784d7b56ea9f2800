"""The queries of this subpackage and, where SQL can express one, DuckDB SQL for its rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embed_dedup, langid, lexical, lm_scoring, merkle, minhash, oracles, packing, personal, secrets, store, substring, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    samples = langid.sample(docs.where(~held_out))
    found = langid.identify(docs, samples)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_char")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocab)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), langid.remainder(F.col("doc_id"), 7) == 2)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(_table(spark, sf_dir, "embeddings"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(_table(spark, sf_dir, "documents"), percent=85)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(_table(spark, sf_dir, "documents"), with_text=False)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), nameless=True))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "warc")
    warc.write(warc.resolve(_table(spark, sf_dir, "pages")), path, compression="gzip")
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op11_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.scan(_table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.index(_table(spark, sf_dir, "documents"), store.new_path(spark, "postings"))
    return lexical.search(found, _table(spark, sf_dir, "benchmark"), k=20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.prove(_table(spark, sf_dir, "documents"), claimed=merkle.tampered_leaf()))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_secret_scan": op10_secret_scan,
    "op11_pii_scan": op11_pii_scan,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
