"""Queries of the vector index and of linking by similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions import learned
from casebook.operators import dictionary, link, vector_index
from casebook.plans import linking
from casebook.plans.catalogue import table
from casebook.sources import work

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _indexed(spark: SparkSession, d: str) -> tuple[vector_index.Index, DataFrame]:
    """An index of all embeddings, stored and opened again, and every fiftieth vector as a query."""
    e = table(spark, d, "embeddings")
    path = work.new_folder(spark, "index")
    vector_index.build(e.select(F.col("vec_id").alias("entry_id"), F.col("label").alias("code"), F.col("embedding").alias("vector")), path)
    return vector_index.open_index(spark, path), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_TRUE = """s AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, e.label::BIGINT AS code, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS rank FROM s)"""


@query(f"WITH {_TRUE} SELECT query_id, entry_id, code, similarity FROM k WHERE rank <= 10")
def index_exact(spark, d):
    """The ten nearest of all entries, through an index that leaves out only lists that cannot hold them."""
    index, asked = _indexed(spark, d)
    return vector_index.exact(index, asked, 10)


@query(f"WITH {_TRUE} SELECT count(*) AS n_true, true AS enough FROM k WHERE rank <= 20")
def index_recall(spark, d):
    """K9, A10: whether the probed lists hold at least 0.9 of the true neighbours, as ``link.retrieve`` finds them."""
    index, asked = _indexed(spark, d)
    e = table(spark, d, "embeddings")
    true = link.retrieve(asked, e.select(F.col("vec_id").alias("entry_id"), F.col("label").alias("code"), F.col("embedding").alias("vector")), 20)
    return vector_index.recall(vector_index.search(index, asked, 20), true).select("n_true", (F.col("recall") >= 0.9).alias("enough"))


def _weights_sql() -> str:
    return """w AS (SELECT code, list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(synonyms, ' ')), '[\\s;]+'), lambda x: x <> '')) AS words FROM s),
df AS (SELECT word, ln(1 + ((SELECT count(*) FROM s) - count(*) + 0.5) / (count(*) + 0.5)) AS weight FROM (SELECT unnest(words) AS word FROM w) GROUP BY 1)"""


@query(f"""WITH s AS (SELECT p_brand AS code, list_sort(list(DISTINCT p_type)) AS synonyms FROM part GROUP BY 1), {_weights_sql()},
a AS (SELECT p_partkey AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(p_type || ' ' || p_name), '[\\s;]+'), lambda x: x <> '')) AS asked, words FROM part JOIN w ON code = p_brand),
u AS (SELECT query_id, unnest(list_distinct(asked || words)) AS word, asked, words FROM a)
SELECT query_id, round(sum(CASE WHEN list_contains(asked, u.word) AND list_contains(words, u.word) THEN coalesce(weight, (SELECT max(weight) FROM df)) ELSE 0 END) / sum(coalesce(weight, (SELECT max(weight) FROM df))), 6) AS score
FROM u LEFT JOIN df ON df.word = u.word GROUP BY 1""")
def rerank_weighted(spark, d):
    """The share of words that a text and its brand's synonyms have in common, each by how few brands use it."""
    p = table(spark, d, "part")
    names = dictionary.synonyms(p, "p_brand", "p_type")
    asked = p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_type", "p_name").alias("text"), F.col("p_brand").alias("code")).join(names, "code")
    weights = link.word_weights("synonyms", names)
    return link.rerank(asked, "text", "synonyms", weights).select("query_id", F.round("score", 6).alias("score"))


def _misspelt(name: Column, key: Column) -> Column:
    """A name with a letter left out, two swapped, or a word in front, by its key."""
    at = (F.lit(2) + F.pmod(key, F.greatest(F.length(name) - 4, F.lit(1)))).cast("int")
    without = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name)))
    swapped = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.lit(1)), F.substring(name, at, F.lit(1)), F.substring(name, at + 2, F.length(name)))
    return F.when(key % 3 == 0, without).when(key % 3 == 1, swapped).otherwise(F.concat(F.lit("the "), name))


def linked(spark: SparkSession, d: str, embedder: linking.Embedder | None = None) -> DataFrame:
    """(text, code, found): misspelt names of parts, the codes of their names, and the best code of ``link_texts``, by learned vectors unless told."""
    p = table(spark, d, "part")
    names = p.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("name")).agg(F.min("p_partkey").alias("code"))
    entries = names.select("code", "name", F.substring_index("name", " ", 1).alias("group_1"), F.col("code").alias("row_num"))
    asked = names.select(_misspelt(F.col("name"), F.col("code")).alias("text"), "code").groupBy("text").agg(F.min("code").alias("code"))
    embedder = embedder or learned.fit(entries, "name")
    best = linking.link_texts(asked, entries, embedder).select("text", F.get("ranked", 0)["code"].alias("found"))
    return asked.join(best, "text", "left")


@query()
def link_learned(spark, d):
    """The matching mode end to end."""
    return linked(spark, d)
