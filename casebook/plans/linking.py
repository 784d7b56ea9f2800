"""Linking of records to the dictionary, end to end (U12, U13): every distinct text once, then back to its records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions import records
from casebook.operators import dictionary, link

Embedder = Callable[[pd.Series], list[list[float]]]
WIDTH = 128


def hashed_trigrams(texts: pd.Series) -> list[list[float]]:
    """The built-in embedder: counts of letter trigrams, hashed to ``WIDTH`` places, at unit length."""
    out = []
    for t in texts:
        v = np.zeros(WIDTH)
        low = f"  {(t or '').lower()} "
        for k in range(len(low) - 2):
            v[crc32(low[k : k + 3].encode()) % WIDTH] += 1
        norm = np.sqrt((v * v).sum())
        out.append((v / norm if norm else v).tolist())
    return out


def embedded(df: DataFrame, text: str, embedder: Embedder, vector: str = "vector") -> DataFrame:
    """``df`` with a vector of each text."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(embedder(part), index=part.index)

    return df.withColumn(vector, run(text))


def link_texts(texts: DataFrame, entries: DataFrame, embedder: Embedder = hashed_trigrams, scorer: link.Scorer | None = None, weighted: bool = True, retrieve: Callable[..., DataFrame] = link.retrieve, k: int = link.RETRIEVAL_K, n: int = link.TOP_N, accept: float | None = None) -> DataFrame:
    """(text, ranked) of distinct texts.

    ``entries`` has code, name, groups and ``row_num``. Retrieval is over synonyms, by ``retrieve`` (queries, dictionary, k), such as a search in
    a vector index; ranking is over codes, with words ``weighted`` by how few codes have them; groups and the name shown are those of a code's first row.
    """
    synonyms = dictionary.entries(entries)
    named = embedded(synonyms.withColumn("entry_id", F.xxhash64("code", "description")), "description", embedder)
    asked = embedded(texts.select("text").withColumn("query_id", F.xxhash64("text")), "text", embedder)
    names = dictionary.synonyms(entries)
    found = link.best_by_code(retrieve(asked, named.select("entry_id", "code", "vector"), k))
    pairs = found.join(names, "code").join(texts.select("text", F.xxhash64("text").alias("query_id")), "query_id")
    scored = link.rerank(pairs, "text", "synonyms", link.word_weights("synonyms", names) if weighted and scorer is None else None, scorer)
    if scorer is None:  # words say nothing of misspelt ones, vectors do
        scored = scored.withColumn("score", F.col("score") + F.col("similarity"))
    scored = scored.withColumn("score", link.adjusted(F.col("score"), F.col("text"), F.col("synonyms")))
    best = link.top(scored, "text", "score", n, accept)
    values = {"name": "name"} | {f"group_{g}": f"group_{g}" for g in records.GROUPS if f"group_{g}" in entries.columns}
    return link.ranked(dictionary.lookup(best, F.col("code"), entries, F.col("code"), values), "text")


def link_exactly(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(text, ranked) by equality with a dictionary name; the last row of a name tells the code, its first row the groups."""
    hit = dictionary.lookup(texts.select("text"), F.col("text"), entries, F.trim("name"), {"code": "code"}, last=True).where("code is not null")
    values = {f"group_{g}": f"group_{g}" for g in records.GROUPS if f"group_{g}" in entries.columns}
    out = dictionary.lookup(hit, F.col("code"), entries, F.col("code"), values) if values else hit
    return link.ranked(out.withColumns({"rank": F.lit(1), "name": F.col("text"), "score": F.lit(None).cast("double")}), "text")


def link_records(records_: DataFrame, key: str, entries: DataFrame, exact: bool = False, **options) -> DataFrame:
    """``records_`` with ``ranked`` for the primary diagnosis and ``container_ranked``, one array for each container in order."""
    long, texts = link.distinct_texts(records_, key)
    linked = link_exactly(texts, entries) if exact else link_texts(texts, entries, **options)
    back = long.join(linked, "text", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast(records.RANKED)))
    primary = F.max(F.when(F.col("slot") == -1, F.struct("slot", "ranked")))["ranked"]
    many = F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") >= 0, F.struct("slot", "ranked")))), lambda s: s["ranked"])
    return records_.join(back.groupBy(key).agg(primary.alias("ranked"), many.alias("container_ranked")), key, "left")
