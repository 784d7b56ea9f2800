"""A corpus pipeline over ``documents``: identified, deduplicated, decontaminated, redacted and packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but the last return
the columns of ``docs``; the last returns the pieces of packed sequences with their ids.

Cases: a null or wordless text goes in the first stage.  Of rows that repeat an id, each is judged by its own text; as near duplicates,
those of one id and text are one document.  Rows with a null id are rows like others, but are linked with nothing.  Of near copies, the smallest id stays.
Extra columns stay up to the last stage, whatever their names; an empty table passes all stages as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import decontaminate, langid, minhash, packing, secrets, store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by a model of their labelled ones; those without a letter go, and those that parse worse than any labelled one."""
    return langid.keep_identified(docs, langid.sample(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of documents with similarity 0.8 or more."""
    return minhash.deduplicate(docs, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item; items without an id count like others."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), nameless=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither a suffix automaton nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store.materialize(docs, f"stage{k}")
    return docs
