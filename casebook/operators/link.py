"""Linking texts to dictionary concepts: retrieval, deduplication, reranking, ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions import records

#: Candidates, results and score rules.
RETRIEVAL_K, TOP_N = 50, 5
PHRASE_BONUS, MISSING_PENALTY, MISSING_WORDS = 0.15, 0.10, 2
#: Dictionary vectors that one task compares with at a time.
DICTIONARY_BLOCK = 8192
#: Similarities that a task holds at a time.
CELLS = 1 << 20


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision; null for a zero vector."""
    both = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))

    def total(of: Callable[[Column], Column]) -> Column:
        return F.aggregate(both, F.lit(0.0), lambda acc, p: acc + of(p))

    norms = F.sqrt(total(lambda p: p["x"] * p["x"])) * F.sqrt(total(lambda p: p["y"] * p["y"]))
    return total(lambda p: p["x"] * p["y"]) / F.nullif(norms, F.lit(0.0))


def _packed(rows: DataFrame, group: str, names: list[str]) -> DataFrame:
    """One row for each value of ``group``: its ``names`` (numbers) and its vectors, by the first name, as bytes.

    Groups are of bounded size; as bytes they are copied and read without a look at their elements.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names[0])
        packed = {n: [pdf[n].to_numpy(np.int64).tobytes()] for n in names}
        return pd.DataFrame({group: [pdf[group].iloc[0]], **packed, "vectors": [np.stack(pdf["vector"].to_numpy()).astype(np.float64).tobytes()]})

    return rows.groupBy(group).applyInPandas(pack, f"{group} long, " + ", ".join(f"{n} binary" for n in names) + ", vectors binary")


def matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(rows, -1)


def nearest(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest values of each row, equal ones by column; values of -2 are none."""
    if k < sim.shape[1]:  # what ties with the k-th best is ordered with it
        least = -np.partition(-sim, k - 1, axis=1)[:, k - 1]
        rows, flat = np.nonzero(sim >= least[:, None])
        order = np.lexsort((flat, -sim[rows, flat], rows))
        rows, flat = rows[order], flat[order]
        first = np.searchsorted(rows, np.arange(len(sim)))
        keep = np.arange(len(rows)) - first[rows] < k
        rows, flat = rows[keep], flat[keep]
    else:
        rows, flat = np.repeat(np.arange(len(sim)), sim.shape[1]), np.tile(np.arange(sim.shape[1]), len(sim))
    real = sim[rows, flat] > -2.0
    return rows[real], flat[real]


def similarities(q: np.ndarray, e: np.ndarray, digits: int) -> np.ndarray:
    """Cosines of all rows, rounded; -2 where a vector is zero or not finite."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        sim = np.round((q @ e.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((e * e).sum(axis=1))), digits)
    return np.where(np.isfinite(sim), sim, -2.0)


FOUND = "query_id long, entry_id long, code long, similarity double"


def tiles(k: int, digits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of packed queries (query_id, vectors) and packed entries (entry_id, code, entries) as each query's ``k`` best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield tile(r, r, k, digits)

    return run


def tile(asked, side, k: int, digits: int) -> pd.DataFrame:
    """The ``k`` best of the packed entries ``side`` for each of the packed queries ``asked``."""
    ids, entries, codes = (np.frombuffer(x, np.int64) for x in (asked.query_id, side.entry_id, side.code))
    queries, vectors = matrix(asked.vectors, len(ids)), matrix(side.entries, len(entries))
    each = max(1, CELLS // max(1, len(entries)))
    found = []
    for a in range(0, max(1, len(ids)), each):
        sim = similarities(queries[a : a + each], vectors, digits)
        rows, flat = nearest(sim, k)
        found.append((ids[a + rows], entries[flat], codes[flat], sim[rows, flat]))
    return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query_id", "entry_id", "code", "similarity"), zip(*found, strict=True), strict=True)})


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, ties by entry."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "entry_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def plain_queries(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")


def plain_entries(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(F.col("entry_id").cast("long").alias("entry_id"), F.col("code").cast("long").alias("code"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")


def retrieve(queries: DataFrame, dictionary: DataFrame, k: int = RETRIEVAL_K, digits: int = 6) -> DataFrame:
    """L9 and the first half of A10: the ``k`` entries most similar to each query.

    ``queries`` is (query_id, vector), ``dictionary`` (entry_id, code, vector).  Result: query_id, entry_id, code and similarity,
    rounded before ranking, ties by entry_id.  Both are packed to blocks of bounded size, as bytes, and each block of queries meets each block of
    entries in one matrix product; of each, only a query's k best travel to the final ranking.  No pair of rows is formed by a join.
    ``vector_index`` looks at a part of the entries instead.
    """
    side, asked = plain_entries(dictionary), plain_queries(queries)
    blocks, groups = (max(1, -(-df.count() // DICTIONARY_BLOCK)) for df in (side, asked))
    entries = _packed(side.withColumn("block", F.pmod(F.xxhash64("entry_id"), F.lit(blocks))), "block", ["entry_id", "code"]).withColumnRenamed("vectors", "entries")
    asked = _packed(asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups))), "part", ["query_id"])
    # every block of queries meets every block of entries
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    entries = entries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["query_id", "entry_id", "code", "similarity"])
        return tile(left.iloc[0], right.iloc[0], k, digits)

    found = asked.groupBy("block", "part").cogroup(entries.groupBy("block", "part")).applyInPandas(best, FOUND)
    return best_of(found, k)


def best_by_code(candidates: DataFrame, first_synonym: bool | Column = False) -> DataFrame:
    """The second half of A10: of each query and code, the most similar entry; or, without a prefilter, the first one.

    ``first_synonym`` may be a condition on a query's rows, so that both ways share one retrieval.
    """
    flag = first_synonym if isinstance(first_synonym, Column) else F.lit(first_synonym)
    by = [F.when(~flag, -F.col("similarity")), "entry_id"]
    rank = F.row_number().over(Window.partitionBy("query_id", "code").orderBy(*by))
    return candidates.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def word_weights(synonyms: Column | str, entries: DataFrame) -> DataFrame:
    """(word, weight): how rare a word is among the entries' synonyms, as ln(1 + (N - df + 0.5) / (df + 0.5))."""
    words = entries.select(F.explode(F.array_distinct(_words(F.array_join(synonyms, " ")))).alias("word"))
    df, n = words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), entries.count()
    return df.select("word", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)[\s;]+"), lambda w: w != "")


def rerank(candidates: DataFrame, text: str, synonyms: str, weights: DataFrame | None = None, scorer: Scorer | None = None, score: str = "score") -> DataFrame:
    """A score of each pair of a text and its candidate's synonyms.

    The built-in one is in expressions: the weight of the distinct words that both have in common, over that of all words of either, so that long
    synonyms count for no more than short ones.  Words weigh 1, or what ``weights`` (word, weight) says; a word that it lacks weighs the most of all.
    ``scorer`` is a vectorised function in its place.
    """
    if scorer is not None:

        @F.pandas_udf("double")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for a, b in parts:
                yield scorer(a, b)

        return candidates.withColumn(score, run(F.col(text), F.array_join(synonyms, " ; ")))
    one, other = F.array_distinct(_words(F.coalesce(F.col(text), F.lit("")))), F.array_distinct(_words(F.array_join(F.coalesce(F.col(synonyms), F.array().cast("array<string>")), " ")))
    if weights is None:
        union = F.size(F.array_union(one, other))
        return candidates.withColumn(score, F.when(union > 0, F.size(F.array_intersect(one, other)) / union).otherwise(F.lit(0.0)))
    # each distinct pair of texts is scored once, and its words meet their weights by a join
    pairs = candidates.select(F.col(text).alias("_text"), F.col(synonyms).alias("_synonyms")).distinct().withColumn("_pair", F.xxhash64("_text", "_synonyms"))
    one, other = (F.array_distinct(_words(c)) for c in (F.coalesce("_text", F.lit("")), F.coalesce(F.array_join("_synonyms", " "), F.lit(""))))
    words = pairs.select("_text", "_synonyms", F.array_intersect(one, other).alias("_both"), F.explode_outer(F.array_union(one, other)).alias("word"))
    most = weights.agg(F.max("weight")).first()[0]
    words = words.join(weights, "word", "left").withColumn("_w", F.coalesce("weight", F.lit(1.0 if most is None else most)))
    total = F.sum(F.when(F.col("word").isNotNull(), F.col("_w")))
    common = F.sum(F.when(F.array_contains("_both", F.col("word")), F.col("_w")).otherwise(0.0))
    scores = words.groupBy("_text", "_synonyms").agg((common / total).alias("_score"))
    same = candidates[text].eqNullSafe(scores["_text"]) & candidates[synonyms].eqNullSafe(scores["_synonyms"])
    return candidates.join(scores, same).withColumn(score, F.coalesce("_score", F.lit(0.0))).drop("_text", "_synonyms", "_score")


def lacking(text: Column, other: Column) -> Column:
    """The distinct lower-case words of a text that another one lacks."""
    return F.array_except(F.split(F.lower(text), " "), F.split(F.lower(other), " "))


def adjusted(score: Column, text: Column, synonyms: Column) -> Column:
    """The score, more for each synonym that the text contains, less if the longest one has many words it lacks."""
    low = F.lower(text)
    names = F.transform(synonyms, lambda s: F.lower(s))
    within = F.size(F.filter(names, lambda s: F.contains(low, s)))
    longest = F.element_at(F.array_sort(F.transform(names, lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))), -1)["s"]
    return score + within * F.lit(PHRASE_BONUS) - F.when(F.size(lacking(longest, text)) >= MISSING_WORDS, F.lit(MISSING_PENALTY)).otherwise(F.lit(0.0))


def top(candidates: DataFrame, query: str = "query_id", score: str = "score", n: int = TOP_N, accept: float | None = None) -> DataFrame:
    """The ``n`` best of each query by score, ties by code, then without those below ``accept``; ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), "code"))
    out = candidates.withColumn("rank", rank).where(F.col("rank") <= n)
    return out if accept is None else out.where(F.col(score) >= accept)


def ranked(tops: DataFrame, query: str = "query_id", score: str = "score") -> DataFrame:
    """One row for each query, with ``ranked`` predictions in order."""
    fields = [F.col("rank").cast("int").alias("rank"), F.col("code").cast("long").alias("code"), F.col("name").cast("string").alias("name") if "name" in tops.columns else F.lit(None).cast("string").alias("name"), F.col(score).cast("double").alias("score")]
    fields += [F.col(f"group_{g}").cast("string").alias(f"group_{g}") if f"group_{g}" in tops.columns else F.lit(None).cast("string").alias(f"group_{g}") for g in records.GROUPS]
    return tops.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(records.RANKED).alias("ranked"))


def distinct_texts(records_: DataFrame, key: str, primary: str = "primary_diagnosis", containers: str | None = "containers") -> tuple[DataFrame, DataFrame]:
    """Every text to link as (key, slot, text), slot -1 the primary, and the distinct texts, each linked once."""
    slots = F.array(F.struct(F.lit(-1).alias("slot"), F.col(primary).alias("text")))
    if containers:
        own = F.coalesce(F.col(containers), F.array().cast(records_.schema[containers].dataType))
        slots = F.concat(slots, F.transform(own, lambda c, k: F.struct(k.alias("slot"), c["diagnosis"].alias("text"))))
    long = records_.select(key, F.explode(slots).alias("s")).select(key, "s.slot", F.trim("s.text").alias("text"))
    return long, long.where("text <> ''").select("text").distinct()
