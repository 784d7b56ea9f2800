"""Queries over the driver's tables, one for each operator or family, each with DuckDB SQL for the same rows.

Stand-ins (SURVEY §7.4): embeddings are a dictionary (label is the code, vec_id the synonym), and those with
an id divisible by 50 are also queries, against all others; nation and region are levels of groups; lineitem rows
are containers of orders; labels are truths about documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook import schemas
from casebook.functions import payload, records, text
from casebook.operators import compare, confusion, dictionary, extraction, link, merge, metrics, report, spans, stratify
from casebook.sources import readers

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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- linking -----------------------------------------------------------------------------

GROUPS = (1, 2, 3, 4)
K = (1, 3, 5)

_SIMILAR = """
q AS (SELECT vec_id AS query_id, label AS gt_code, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, q.gt_code, e.vec_id AS entry_id, e.label::BIGINT AS code,
      round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 6) AS similarity
      FROM q JOIN embeddings e ON e.vec_id <> q.query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS rn FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, code ORDER BY similarity DESC, entry_id) AS cr FROM k WHERE rn <= 50),
t AS (SELECT query_id, gt_code, code, similarity,
      row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, code) AS rank FROM c WHERE cr = 1),
top AS (SELECT * FROM t WHERE rank <= 5)"""

_HIERARCHY = """
h AS (SELECT n_nationkey::BIGINT AS code, n_name AS group_1, 'R' || n_regionkey AS group_2, r_name AS group_3, CASE WHEN n_regionkey < 3 THEN 'low' END AS group_4
      FROM nation JOIN region ON n_regionkey = r_regionkey)"""

_REPORT = f"""{_SIMILAR},{_HIERARCHY},
p AS (SELECT top.*, h.group_1, h.group_2, h.group_3, h.group_4 FROM top LEFT JOIN h USING (code)),
r AS (SELECT p.query_id AS case_id, any_value(p.gt_code)::BIGINT AS gt_code,
      max(CASE WHEN rank = 1 THEN p.code END) AS pred_code, max(CASE WHEN rank = 1 THEN similarity END) AS pred_score,
      {", ".join(f"coalesce(bool_or(p.code = p.gt_code AND rank <= {k}), false) AS top{k}_correct" for k in K)},
      {", ".join(f"any_value(g.group_{g}) AS gt_group_{g}, max(CASE WHEN rank = 1 THEN p.group_{g} END) AS pred_group_{g}" for g in GROUPS)},
      {", ".join(f"coalesce(bool_or(p.group_{g} = g.group_{g} AND rank <= {k}), false) AS top{k}_group_{g}_correct" for g in GROUPS for k in K)}
      FROM p LEFT JOIN h g ON g.code = p.gt_code GROUP BY p.query_id)"""


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("group_1"), F.concat(F.lit("R"), "n_regionkey").alias("group_2"), F.col("r_name").alias("group_3"), F.when(F.col("n_regionkey") < 3, "low").alias("group_4"), F.col("n_nationkey").alias("row_num"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    entries = e.select(F.col("vec_id").alias("entry_id"), F.col("label").alias("code"), F.col("embedding").alias("vector"))
    found = link.retrieve(asked, entries, link.RETRIEVAL_K + 1).where("entry_id <> query_id")
    rank = F.row_number().over(_by("query_id", F.desc("similarity"), F.asc("entry_id")))
    return found.withColumn("rn", rank).where(F.col("rn") <= link.RETRIEVAL_K).drop("rn")


def _by(key: str, *order: Column):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def _tops(spark: SparkSession, d: str) -> DataFrame:
    return link.top(link.best_by_code(_candidates(spark, d)), score="similarity")


def _report(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), F.col("label").cast("long").alias("gt_code"))
    return _evaluated(spark, d, _tops(spark, d), truth)


def _evaluated(spark: SparkSession, d: str, tops: DataFrame, truth: DataFrame) -> DataFrame:
    levels = _hierarchy(spark, d)
    tops = dictionary.lookup(tops, F.col("code"), levels, F.col("code"), {f"group_{g}": f"group_{g}" for g in GROUPS})
    predictions = link.ranked(tops, score="similarity").select(F.col("query_id").alias("case_id"), F.lit(1).alias("row_num"), "ranked")
    truth = dictionary.lookup(truth.withColumn("row_num", F.lit(1)), F.col("gt_code"), levels, F.col("code"), {f"gt_group_{g}": f"group_{g}" for g in GROUPS})
    return report.report_level(truth, predictions, GROUPS, K).drop("pred_name")


@query(f"WITH {_SIMILAR} SELECT query_id, code, similarity, rank FROM top")
def link_topk_concepts(spark, d):
    """L9, A10, W2 ranks."""
    return _tops(spark, d).select("query_id", "code", "similarity", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT p_brand AS code, list_sort(list(DISTINCT p_name)) AS synonyms FROM part GROUP BY 1),
q AS (SELECT p_partkey AS query_id, p_type || ' ' || p_name AS text, p_brand AS code FROM part),
j AS (SELECT q.query_id, q.text, s.synonyms, list_sort(list_transform(s.synonyms, lambda x: {'n': length(x), 's': lower(x)}))[-1].s AS longest FROM q JOIN s USING (code))
SELECT query_id, round(len(list_filter(synonyms, lambda x: contains(lower(text), lower(x)))) * 0.15
 - CASE WHEN len(list_filter(list_distinct(string_split(longest, ' ')), lambda w: NOT list_contains(string_split(lower(text), ' '), w))) >= 2 THEN 0.10 ELSE 0 END, 6) AS score FROM j""")
def link_rank_adjusted(spark, d):
    """W2 bonus and penalty."""
    p = table(spark, d, "part")
    names = dictionary.synonyms(p, "p_brand", "p_name")
    asked = p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_type", "p_name").alias("text"), F.col("p_brand").alias("code"))
    return asked.join(names, "code").select("query_id", F.round(link.adjusted(F.lit(0.0), F.col("text"), F.col("synonyms")), 6).alias("score"))


@query("""WITH d AS (SELECT p_name AS name, max(p_partkey) AS code FROM part GROUP BY 1)
SELECT c_custkey AS id, d.code FROM customer LEFT JOIN d ON d.name = c_name UNION ALL SELECT p_partkey, d.code FROM part LEFT JOIN d ON d.name = p_name""")
def link_exact_lookup(spark, d):
    """L2: exact text to code, the last row wins."""
    p, c = table(spark, d, "part"), table(spark, d, "customer")
    asked = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).union(p.select("p_partkey", "p_name"))
    return dictionary.lookup(asked, F.col("name"), p, F.col("p_name"), {"code": "p_partkey"}, order="p_partkey", last=True).select("id", "code")


@query("""WITH d AS (SELECT lower(trim(p_type)) AS k, arg_max(p_brand, p_partkey) AS last_brand, arg_min(p_brand, p_partkey) AS first_brand FROM part GROUP BY 1)
SELECT p_partkey AS id, last_brand, first_brand FROM part LEFT JOIN d ON lower(trim(p_type)) = k""")
def link_match_key_lookup(spark, d):
    """L5 (last row by match key) and L3 (first row)."""
    p = table(spark, d, "part")
    key = text.match_key(F.col("p_type"))
    out = dictionary.lookup(p.select("p_partkey", "p_type"), key, p, key, {"last_brand": "p_brand"}, order="p_partkey", last=True)
    out = dictionary.lookup(out, key, p, key, {"first_brand": "p_brand"}, order="p_partkey")
    return out.select(F.col("p_partkey").alias("id"), "last_brand", "first_brand")


@query(f"WITH {_HIERARCHY.strip()} SELECT vec_id, coalesce(group_1, 'none') AS group_1, coalesce(group_3, 'none') AS group_3 FROM embeddings LEFT JOIN h ON h.code = label")
def link_code_groups(spark, d):
    """L4: groups overwritten where the dictionary has the code."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.lit("none").alias("group_1"), F.lit("none").alias("group_3"))
    return dictionary.overwrite_on_hit(e, F.col("label").cast("long"), _hierarchy(spark, d), F.col("code"), {"group_1": "group_1", "group_3": "group_3"}).drop("label")


@query("SELECT p_type AS source, arg_max(p_brand, p_partkey) AS target FROM part GROUP BY 1")
def link_group_mapping(spark, d):
    """L7, L11."""
    return dictionary.mapping(table(spark, d, "part"), "p_type", "p_brand", order="p_partkey")


@query("SELECT p_brand AS code, array_to_string(list_sort(list(DISTINCT trim(p_name))), '|') AS synonyms, count(DISTINCT trim(p_name)) AS n FROM part WHERE trim(p_name) <> '' GROUP BY 1")
def dict_synonyms(spark, d):
    """A11."""
    s = dictionary.synonyms(table(spark, d, "part"), "p_brand", "p_name")
    return s.select("code", F.array_join("synonyms", "|").alias("synonyms"), F.size("synonyms").cast("long").alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS key, -1 AS slot, min(l_shipmode_) AS t FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1
UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1, l_returnflag || l_linestatus FROM lineitem)
SELECT t AS text, count(*) AS n_slots, count(DISTINCT key) AS n_keys FROM l GROUP BY 1""")
def link_distinct_texts(spark, d):
    """Slots of records, and the distinct texts that are linked once each."""
    l = table(spark, d, "lineitem").withColumn("diagnosis", F.concat("l_returnflag", "l_linestatus"))
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "diagnosis")))
    r = l.groupBy(F.col("l_orderkey").alias("key")).agg(F.min("diagnosis").alias("primary_diagnosis"), items.alias("containers"))
    long, distinct = link.distinct_texts(r, "key")
    # a frequent text has most slots, so they are counted before they meet their text
    counts = long.groupBy("text").agg(F.count("*").alias("n_slots"), F.count_distinct("key").alias("n_keys"))
    return counts.join(distinct, "text")


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS a, list_distinct(list_filter(string_split(replace(lower(p_type || ' ; ' || p_brand), ';', ' '), ' '), lambda x: x <> '')) AS b FROM part)
SELECT p_partkey AS query_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM w""")
def link_rerank(spark, d):
    """The built-in reranker."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.array("p_type", "p_brand").alias("synonyms"))
    return link.rerank(p, "text", "synonyms").select("query_id", F.round("score", 6).alias("score"))


@query("SELECT DISTINCT trim(p_type) AS term FROM part WHERE trim(p_type) <> ''")
def dict_terms(spark, d):
    """S3."""
    return dictionary.terms(table(spark, d, "part"), "p_type")


@query("SELECT list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: NOT list_contains(string_split(lower(p_type), ' '), x)))) AS lacking, p_partkey FROM part")
def words_lacking(spark, d):
    """Words of one text that another lacks."""
    return table(spark, d, "part").select(F.array_sort(link.lacking(F.col("p_name"), F.col("p_type"))).alias("lacking"), "p_partkey")


# --- evaluation ----------------------------------------------------------------------------

_ACC = ", ".join([*(f"avg(top{k}_correct::INT) AS primary_top{k}_accuracy" for k in K), *(f"avg(top{k}_group_{g}_correct::INT) AS group_{g}_top{k}_accuracy" for g in GROUPS for k in K)])
_GIVEN = ", ".join(f"avg(CASE WHEN top1_group_{g}_correct THEN top1_correct::INT END) AS top1_given_group_{g}" for g in GROUPS)


@query(f"WITH {_REPORT} SELECT * FROM r")
def eval_report_level(spark, d):
    """L1, J7-J9."""
    return _report(spark, d)


@query(f"WITH {_REPORT} SELECT count(*) AS n_cases, {_ACC}, {_GIVEN} FROM r")
def eval_summary(spark, d):
    """A1, A3-A5."""
    return metrics.summary(_report(spark, d), GROUPS, top_k=K)


_NAMES = ["n_cases", *(f"primary_top{k}_accuracy" for k in K), *(f"group_{g}_top{k}_accuracy" for g in GROUPS for k in K), *(f"top1_given_group_{g}" for g in GROUPS)]


@query(f"WITH {_REPORT}, m AS (SELECT count(*) AS n_cases, {_ACC}, {_GIVEN} FROM r) " + " UNION ALL ".join(f"SELECT 'base' AS run, '{n}' AS metric, {n}::DOUBLE AS value FROM m" for n in _NAMES))
def eval_summary_long(spark, d):
    """A5 as rows, for comparison."""
    return metrics.melt(metrics.summary(_report(spark, d), GROUPS, top_k=K), "base")


_DOCS = """
f AS (SELECT l.doc_id AS case_id, coalesce(l.quality = 1, false) AS gt_quality, coalesce(d.n_chars >= 1000, false) AS pred_quality, coalesce(l.toxic = 1, false) AS gt_toxic,
      coalesce(contains(lower(d.text), 'hate'), false) AS pred_toxic, d.n_chars, d.lang, d.source FROM labels l JOIN documents d USING (doc_id))"""


def _flags(spark: SparkSession, d: str) -> DataFrame:
    l, docs = table(spark, d, "labels"), table(spark, d, "documents")
    no = F.lit(False)
    return l.join(docs, "doc_id").select(F.col("doc_id").alias("case_id"), F.coalesce(F.col("quality") == 1, no).alias("gt_quality"), F.coalesce(F.col("n_chars") >= 1000, no).alias("pred_quality"), F.coalesce(F.col("toxic") == 1, no).alias("gt_toxic"), F.coalesce(F.contains(F.lower("text"), F.lit("hate")), no).alias("pred_toxic"), "n_chars", "lang", "source")


def _mcc_sql(a: str, b: str) -> str:
    n = {k: f"count(*) FILTER ({e})::DOUBLE" for k, e in {"tp": f"{a} AND {b}", "tn": f"NOT {a} AND NOT {b}", "fp": f"NOT {a} AND {b}", "fn": f"{a} AND NOT {b}"}.items()}
    root = f"(sqrt({n['tp']} + {n['fp']}) * sqrt({n['tp']} + {n['fn']}) * sqrt({n['tn']} + {n['fp']}) * sqrt({n['tn']} + {n['fn']}))"
    return f"round(CASE WHEN {root} > 0 THEN ({n['tp']} * {n['tn']} - {n['fp']} * {n['fn']}) / {root} ELSE 0 END, 9)"


@query(f"WITH {_DOCS} SELECT lang, count(*) AS n, {_mcc_sql('gt_quality', 'pred_quality')} AS quality_mcc, {_mcc_sql('gt_toxic', 'pred_toxic')} AS toxic_mcc FROM f GROUP BY lang")
def eval_mcc(spark, d):
    """A2, with constant predictions among the groups."""
    f = _flags(spark, d)
    return f.groupBy("lang").agg(F.count("*").alias("n"), *(F.round(metrics.mcc(F.col(f"gt_{x}"), F.col(f"pred_{x}")), 9).alias(f"{x}_mcc") for x in ("quality", "toxic")))


_HARD = {"long": "n_chars > 2000", "foreign": "lang <> 'en'", "toxic": "gt_toxic", "unknown": "lang = 'xx'"}


@query("WITH " + _DOCS + ", c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS category, gt_quality = pred_quality AS ok FROM f WHERE {e}" for n, e in _HARD.items()) + "), n AS (SELECT unnest(['long', 'foreign', 'toxic', 'unknown']) AS category) SELECT category, count(ok) AS n, avg(ok::INT) AS accuracy FROM n LEFT JOIN c USING (category) GROUP BY category")
def eval_hard_cases(spark, d):
    """Overlapping categories, an empty one among them."""
    f = _flags(spark, d)
    return stratify.hard_cases(f, {n: F.expr(e) for n, e in _HARD.items()}, [metrics.accuracy(F.col("gt_quality") == F.col("pred_quality")).alias("accuracy")])


_CAUSES = {"D": "lang <> 'en'", "N": "n_chars < 300", "P": "gt_toxic", "C": "source = 'src0'"}


@query("WITH " + _DOCS + ", e AS (SELECT concat_ws('+', " + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in _CAUSES.items()) + ") AS k FROM f WHERE gt_quality <> pred_quality), "
       "g AS (SELECT concat_ws('+', CASE WHEN i & 8 > 0 THEN 'D' END, CASE WHEN i & 4 > 0 THEN 'N' END, CASE WHEN i & 2 > 0 THEN 'P' END, CASE WHEN i & 1 > 0 THEN 'C' END) AS k FROM range(16) t(i)) "
       "SELECT CASE WHEN g.k = '' THEN 'none' ELSE g.k END AS combination, count(e.k) AS n, count(e.k) / any_value(t.total) AS fraction FROM g LEFT JOIN e USING (k), (SELECT count(*) AS total FROM e) t WHERE total > 0 GROUP BY g.k")  # fmt: skip
def eval_error_partition(spark, d):
    """A7."""
    return stratify.error_partition(_flags(spark, d), F.col("gt_quality") != F.col("pred_quality"), {n: F.expr(e) for n, e in _CAUSES.items()})


@query("""WITH n AS (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1)
SELECT coalesce(c < 25, false) AS is_rare, count(*) AS n, avg((l_returnflag = 'N')::INT) AS accuracy FROM lineitem JOIN n USING (l_partkey) GROUP BY 1""")
def eval_rare_common(spark, d):
    """A8 over part frequencies."""
    return stratify.rare_common(table(spark, d, "lineitem"), [metrics.accuracy(F.col("l_returnflag") == "N").alias("accuracy")], "l_partkey", 25)


@query(f"WITH {_REPORT} SELECT gt_group_1 AS \"group\", count(*) AS n, {_ACC} FROM r WHERE gt_group_1 IS NOT NULL GROUP BY 1")
def eval_by_group(spark, d):
    """A9."""
    return stratify.by_group(_report(spark, d), "gt_group_1", metrics.columns(GROUPS, K))


@query(f"WITH {_REPORT} " + " UNION ALL ".join(f"SELECT 'gt_group_{g}' AS level, gt_group_{g} AS \"group\", count(*) AS n, {_ACC} FROM r WHERE gt_group_{g} IS NOT NULL GROUP BY 2" for g in GROUPS))
def eval_by_group_sets(spark, d):
    """A9, all levels in one pass."""
    return stratify.by_groups(_report(spark, d), [f"gt_group_{g}" for g in GROUPS], metrics.columns(GROUPS, K))


_SCORED = "e AS (SELECT event_id, value AS pred_score, event_type IN ('click', 'view') AS top1_correct, event_type <> 'purchase' AS top3_correct FROM events WHERE value IS NOT NULL)"
_SWEEP = f"""{_SCORED}, b AS (SELECT min(pred_score) AS low, max(pred_score) AS high, count(*) AS total FROM e),
g AS (SELECT i AS id, CASE WHEN i >= 499 THEN high ELSE low + i * ((high - low) / 499.0::DOUBLE) END AS threshold, total FROM range(500) t(i), b),
w AS (SELECT id, threshold, count(pred_score) / any_value(total) AS coverage, avg(top1_correct::INT) AS top1_accuracy, avg(top3_correct::INT) AS top3_accuracy
      FROM g LEFT JOIN e ON pred_score >= threshold GROUP BY id, threshold)"""


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("value").alias("pred_score"), F.col("event_type").isin("click", "view").alias("top1_correct"), (F.col("event_type") != "purchase").alias("top3_correct"))
    return stratify.threshold_sweep(e, ["top1_correct", "top3_correct"])


@query(f"WITH {_SWEEP} SELECT id, round(threshold, 9) AS threshold, coverage, top1_accuracy, top3_accuracy FROM w")
def eval_threshold_sweep(spark, d):
    """A12, in time linear in the rows."""
    return _sweep(spark, d).withColumn("threshold", F.round("threshold", 9))


@query(f"""WITH {_SWEEP}, l AS (SELECT coverage AS x, lag(coverage) OVER (ORDER BY id) AS lx, top1_accuracy AS y1, lag(top1_accuracy) OVER (ORDER BY id) AS l1, top3_accuracy AS y3, lag(top3_accuracy) OVER (ORDER BY id) AS l3 FROM w)
SELECT round(sum(abs(x - lx) * (y1 + l1) / 2), 9) AS auc_top1_accuracy, round(sum(abs(x - lx) * (y3 + l3) / 2), 9) AS auc_top3_accuracy FROM l""")
def eval_auc(spark, d):
    """A13."""
    out = stratify.auc(_sweep(spark, d), ["top1_accuracy", "top3_accuracy"])
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(f"""WITH {_REPORT}, x AS (SELECT gt_code::VARCHAR AS truth, pred_code::VARCHAR AS pred, count(*) AS n FROM r WHERE gt_code IS NOT NULL AND pred_code IS NOT NULL GROUP BY 1, 2),
l AS (SELECT truth AS label FROM x UNION SELECT pred FROM x), g AS (SELECT a.label AS truth, b.label AS pred FROM l a, l b)
SELECT truth, pred, coalesce(n, 0) AS n, CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY truth) > 0 THEN coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY truth) ELSE 0.0 END AS share FROM g LEFT JOIN x USING (truth, pred)""")
def confusion_normalized(spark, d):
    """A14, P3 data."""
    return confusion.normalized(_report(spark, d), "gt_code", "pred_code")


_VOTE = f"""{_REPORT}, v AS (SELECT DISTINCT gt_group_1 AS label, gt_group_3 AS major, 0 AS side FROM r WHERE gt_group_1 IS NOT NULL AND gt_group_3 IS NOT NULL
UNION ALL SELECT DISTINCT pred_group_1, gt_group_3, 1 FROM r WHERE pred_group_1 IS NOT NULL AND gt_group_3 IS NOT NULL),
m AS (SELECT label, major, count(*) AS votes, min(side) AS side FROM v GROUP BY 1, 2),
w AS (SELECT label, major, votes FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY votes DESC, side, major) AS rn FROM m) WHERE rn = 1),
o AS (SELECT *, row_number() OVER (ORDER BY major, label) - 1 AS position FROM w)"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return confusion.major_groups(_report(spark, d), [("gt_group_1", "gt_group_3"), ("pred_group_1", "gt_group_3")])


@query(f"WITH {_VOTE} SELECT label, major, votes, position FROM o")
def label_major_order(spark, d):
    """L10, W4."""
    return confusion.ordered(_votes(spark, d)).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_VOTE} SELECT major, min(position) AS first, max(position) AS last, count(*) AS n_labels FROM o GROUP BY 1")
def label_blocks(spark, d):
    """W5."""
    out = confusion.blocks(confusion.ordered(_votes(spark, d)))
    return out.select("major", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n_labels")


@query(f"WITH {_DOCS}, t AS (SELECT *, lang = 'en' AS ok, source = 'src0' AS own, gt_quality AND n_chars > 500 AS held FROM f) "
       "SELECT lang AS run, count(*) AS n_cases, avg(ok::INT) AS primary_top1_accuracy, "
       + ", ".join(f"avg((gt_{x} = pred_{x})::INT) AS {x}_accuracy, {_mcc_sql(f'gt_{x}', f'pred_{x}')} AS {x}_mcc" for x in ("quality", "toxic"))
       + ", avg(CASE WHEN held THEN own::INT END) AS container_top1_accuracy, avg((lang <> 'de')::INT) AS group_1_top1_accuracy, avg(CASE WHEN lang <> 'de' THEN ok::INT END) AS top1_given_group_1 FROM t GROUP BY 1")
def eval_bundle_flags(spark, d):
    """A3 and A4 with flags, their correlations, the container part and a group."""
    f = _flags(spark, d)
    wide = f.withColumns({"top1_correct": F.col("lang") == "en", "top1_group_1_correct": F.col("lang") != "de", "container_top1_correct": F.when(F.col("gt_quality") & (F.col("n_chars") > 500), F.col("source") == "src0"), **{f"{x}_correct": F.col(f"gt_{x}") == F.col(f"pred_{x}") for x in ("quality", "toxic")}})
    out = wide.groupBy(F.col("lang").alias("run")).agg(F.count("*").alias("n_cases"), *metrics.columns((1,), (1,), ("quality", "toxic"), "container_"), *metrics.given_group((1,)))
    return out.withColumns({f"{x}_mcc": F.round(f"{x}_mcc", 9) for x in ("quality", "toxic")})


@query(f"WITH {_REPORT}, ranks AS (SELECT query_id AS case_id, list(code ORDER BY rank) AS codes FROM top GROUP BY 1) "
       f"SELECT case_id, gt_code % 5 AS gt_container_code, {', '.join(f'list_contains(codes[1:{k}], gt_code % 5) AS top{k}_correct' for k in K)}, top1_group_1_correct FROM r JOIN ranks USING (case_id) WHERE pred_score IS NOT NULL AND gt_code % 3 <> 0")  # fmt: skip
def eval_container_level(spark, d):
    """Containers with a truth, against the ranks of their record."""
    ranked = link.ranked(_tops(spark, d), score="similarity").select(F.col("query_id").alias("case_id"), F.col("ranked").alias("container_ranked"))
    frame = _report(spark, d).join(ranked, "case_id").withColumn("gt_container_code", F.when(F.col("gt_code") % 3 != 0, F.col("gt_code") % 5))
    out = report.container_level(report.scored(frame))
    return out.select("case_id", "gt_container_code", *(f"top{k}_correct" for k in K), "top1_group_1_correct")


@query(f"WITH {_SWEEP}, l AS (SELECT round(threshold, 9) AS threshold, unnest(['coverage', 'top1_accuracy', 'top3_accuracy']) AS series, unnest([coverage, top1_accuracy, top3_accuracy]) AS value FROM w) SELECT * FROM l WHERE value IS NOT NULL")
def figure_curves(spark, d):
    """P1 data."""
    return compare.figure("curves", _sweep(spark, d)).withColumn("threshold", F.round("threshold", 9))


@query(f"WITH {_SWEEP}, l AS (SELECT coverage, unnest(['top1_accuracy', 'top3_accuracy']) AS series, unnest([top1_accuracy, top3_accuracy]) AS value FROM w) SELECT * FROM l WHERE value IS NOT NULL")
def figure_tradeoff(spark, d):
    """P2 data."""
    return compare.figure("tradeoff", _sweep(spark, d))


# --- comparison of runs ----------------------------------------------------------------------

_SIMPLE = ("primary_top1_accuracy", "primary_top3_accuracy", "group_3_top1_accuracy")


def _two_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over one retrieval: queries of the second, which prefers first synonyms, have odd keys."""
    both = _candidates(spark, d).withColumn("_run", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("query_id", F.col("query_id") * 2 + F.col("_run"))
    tops = link.top(link.best_by_code(both, F.col("query_id") % 2 == 1), score="similarity")
    truth = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.explode(F.array(F.col("vec_id") * 2, F.col("vec_id") * 2 + 1)).alias("case_id"), F.col("label").cast("long").alias("gt_code"))
    name = F.when(F.col("case_id") % 2 == 0, "base-om").otherwise("first-cd")
    bundle = metrics.columns(GROUPS, K)
    wide = _evaluated(spark, d, tops, truth).groupBy(name.alias("run")).agg(*bundle)
    return compare.melted(wide, [*_SIMPLE, "absent"])


_FIRST = _REPORT.replace("PARTITION BY query_id, code ORDER BY similarity DESC, entry_id", "PARTITION BY query_id, code ORDER BY entry_id")
_RUNS = f"a AS (WITH {_REPORT} SELECT 'base-om' AS run, {_ACC} FROM r), z AS (WITH {_FIRST} SELECT 'first-cd' AS run, {_ACC} FROM r), runs AS (SELECT * FROM a UNION ALL SELECT * FROM z)"


@query(f"WITH {_RUNS} SELECT run, {', '.join(_SIMPLE)}, NULL::DOUBLE AS absent FROM runs")
def compare_runs(spark, d):
    """L12, A18."""
    return compare.matrix(_two_runs(spark, d), [*_SIMPLE, "absent"])


@query(f"WITH {_RUNS} SELECT split_part(run, '-', 1) AS base, '-' || split_part(run, '-', 2) AS variant, metric, value FROM (" + " UNION ALL ".join([*(f"SELECT run, '{m}' AS metric, {m} AS value FROM runs" for m in _SIMPLE), "SELECT run, 'absent', NULL FROM runs"]) + ")")
def compare_paired(spark, d):
    """P5, P8 data; T19 keeps runs by prefix."""
    return compare.paired(compare.of_runs(_two_runs(spark, d), ["base", "first"]))


_BARS = f"WITH {_DOCS} SELECT lang AS run, {_mcc_sql('gt_quality', 'pred_quality')} AS quality, {_mcc_sql('gt_toxic', 'pred_toxic')} AS toxic, avg(CASE WHEN source <> 'src0' THEN (gt_quality = pred_quality)::INT END) AS source, avg(CASE WHEN gt_toxic THEN (gt_quality = pred_quality)::INT END) AS toxicity FROM f GROUP BY 1"


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """Runs are languages; long metrics with correlations, accuracies, and accuracies given a group."""
    f = _flags(spark, d)
    right = F.col("gt_quality") == F.col("pred_quality")
    wide = f.groupBy(F.col("lang").alias("run")).agg(
        metrics.accuracy(right).alias("quality_accuracy"),
        *(F.round(metrics.mcc(F.col(f"gt_{x}"), F.col(f"pred_{x}")), 9).alias(f"{x}_mcc") for x in ("quality", "toxic")),
        metrics.conditional(right, F.col("source") != "src0").alias("top1_given_source"),
        metrics.conditional(right, F.col("gt_toxic")).alias("top1_given_toxicity"),
    )
    return compare.melted(wide, [c for c in wide.columns if c != "run"])


@query(f"SELECT run, flag, value FROM ({_BARS}) UNPIVOT INCLUDE NULLS (value FOR flag IN (quality, toxic))")
def compare_mcc(spark, d):
    """P6 data."""
    return compare.figure("mcc", _bars(spark, d))


@query(f'SELECT run, "group", value FROM ({_BARS}) UNPIVOT INCLUDE NULLS (value FOR "group" IN (source, toxicity))')
def compare_given(spark, d):
    """P7 data."""
    return compare.figure("given", _bars(spark, d))


@query("""WITH r AS (SELECT 'run_' || l_returnflag AS run, l_linestatus || (l_linenumber % 3) AS "group", count(*) AS n, avg((l_quantity > 25)::INT) AS accuracy FROM lineitem GROUP BY 1, 2)
SELECT "group", coalesce(max(n) FILTER (run = 'run_N'), max(n) FILTER (run = 'run_R'), max(n) FILTER (run = 'run_A')) AS n, max(accuracy) FILTER (run = 'run_N') AS "run_N", max(accuracy) FILTER (run = 'run_R') AS "run_R", max(accuracy) FILTER (run = 'run_A') AS "run_A" FROM r GROUP BY 1""")
def compare_group_matrix(spark, d):
    """A16, P10 data."""
    l = table(spark, d, "lineitem")
    long = l.groupBy(F.concat(F.lit("run_"), "l_returnflag").alias("run"), F.concat("l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("group")).agg(F.count("*").alias("n"), metrics.accuracy(F.col("l_quantity") > 25).alias("accuracy"))
    return compare.group_matrix(long, ["run_N", "run_R", "run_A"])


@query("SELECT l_suppkey::VARCHAR AS \"group\", count(*) AS n, avg((l_suppkey = l_partkey % 100)::INT) AS accuracy FROM lineitem GROUP BY 1")
def compare_group_accuracy(spark, d):
    """A15."""
    return compare.group_accuracy(table(spark, d, "lineitem").withColumn("guess", F.col("l_partkey") % 100), "l_suppkey", "guess")


@query("""WITH s AS (SELECT lang AS run, avg((n_chars < 300)::INT) AS short, avg((source = 'src0')::INT) AS hot FROM documents GROUP BY 1)
SELECT run, short, hot, round(greatest(1 - short - hot, 0), 9) AS "Other" FROM s""")
def compare_error_stack(spark, d):
    """A19, P9 data, with a part that no run has."""
    wide = table(spark, d, "documents").groupBy(F.col("lang").alias("run")).agg(metrics.accuracy(F.col("n_chars") < 300).alias("short"), metrics.accuracy(F.col("source") == "src0").alias("hot"), F.max(F.lit(None).cast("double")).alias("never"))
    return compare.error_stack(wide, ["short", "hot", "never"]).withColumn("Other", F.round("Other", 9))


@query(f"WITH {_RUNS} SELECT run, " + ", ".join(f"printf('%.4f', {m}) AS {m}" for m in _SIMPLE) + ", '' AS absent FROM runs")
def compare_table(spark, d):
    """P4 data, T21, P12."""
    return compare.figure("table", compare.select_columns(compare.matrix(_two_runs(spark, d), [*_SIMPLE, "absent"]), [*_SIMPLE, "absent", "unheard_of"]))


def _wide(column: str) -> Column:
    """Names with some letters in their wide form, which compatibility composition makes plain again."""
    return F.translate(column, "AEIOUaeiou", "ＡＥＩＯＵａｅｉｏｕ")


@query("SELECT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS name, p_brand AS code, count(*) AS n FROM part GROUP BY 1, 2")
def label_distribution(spark, d):
    """A17, P11 data, T2 over names with wide letters."""
    return compare.label_frequencies(table(spark, d, "part"), text.alphanumeric(_wide("p_type")), "p_brand")


@query("SELECT count(DISTINCT p_partkey) AS n_cases, count(DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))) AS n_names, count(DISTINCT p_brand) AS n_codes FROM part WHERE p_type <> 'PROMO'")
def label_counts(spark, d):
    """A17 totals, T20, over names with wide letters."""
    return compare.label_counts(compare.without_label(table(spark, d, "part"), "p_type", "PROMO"), "p_partkey", text.alphanumeric(_wide("p_name")), "p_brand")


# --- sheets and containers ----------------------------------------------------------------------

def _row_num() -> Column:
    """A number for each row of an order, by line, part and supplier; it tells their order only below a million parts and 100,000 suppliers."""
    return (F.col("l_linenumber") * F.lit(1000000) + F.col("l_partkey")) * F.lit(100000) + F.col("l_suppkey")


def _row_order() -> Column:
    """What the rows of an order are sorted by."""
    return F.struct("l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH s AS (SELECT l_orderkey AS id, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS row_num, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ordinal FROM lineitem WHERE l_returnflag = 'N'),
c AS (SELECT l_orderkey AS id, l_suppkey AS supp, l_quantity AS quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) AS ordinal FROM lineitem WHERE l_quantity > 20 AND l_orderkey IN (SELECT id FROM s)),
j AS (SELECT coalesce(s.id, c.id) AS id, s.row_num, s.part, coalesce(s.ordinal, c.ordinal) AS ordinal, s.id IS NULL AS inserted, c.supp, c.quantity FROM s FULL JOIN c ON s.id = c.id AND s.ordinal = c.ordinal)
SELECT j.id, row_num::BIGINT AS row_num, part, ordinal, inserted, supp, quantity, CASE WHEN NOT inserted AND j.id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20) THEN o_orderstatus END AS status FROM j LEFT JOIN orders ON o_orderkey = j.id""")
def merge_positional(spark, d):
    """L8, W9."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    sheet = l.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("id"), _row_num().alias("row_num"), F.col("l_partkey").alias("part"), _row_order().alias("place"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("quantity")))), lambda c: F.struct(c["supp"].alias("supp"), c["quantity"].alias("quantity")))
    recs = l.where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("id")).agg(items.alias("containers"))
    recs = recs.join(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status_")), "id", "left")
    out = merge.positional(sheet, recs, "id", "place", "containers", ["supp", "quantity"], {"status": "status_"})
    return out.drop("place").withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1 AS is_first FROM lineitem")
def first_occurrence(spark, d):
    """W1."""
    return merge.first_occurrence(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _row_order().alias("place")), "l_orderkey", "place").drop("place")


@query("""SELECT p_partkey, CASE WHEN lower(trim(p_brand)) = lower(trim(p_brand)) THEN 'literal_match' END AS brand_match, CASE WHEN lower(trim(p_type)) = lower(trim(p_name)) THEN 'literal_match' END AS type_match FROM part""")
def literal_match(spark, d):
    """W7, T3; a triple with a missing column is skipped."""
    p = table(spark, d, "part").withColumn("shouted", F.concat(F.lit("  "), F.upper("p_brand"), F.lit("\t")))
    out = merge.match_markers(p, [("p_brand", "shouted", "brand_match"), ("p_type", "p_name", "type_match"), ("p_brand", "nowhere", "none_match")])
    return out.select("p_partkey", "brand_match", "type_match")


@query("""SELECT c_custkey, (n_name IS NOT NULL AND lower(trim(c_mktsegment)) = lower(trim(n_name))) AS same_segment, coalesce(n_nationkey = c_nationkey, false) AS same_nation FROM customer LEFT JOIN nation ON n_nationkey = c_custkey""")
def compare_groups(spark, d):
    """L6, T4."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation").withColumn("c_custkey", F.col("n_nationkey").cast("long"))
    out = merge.compare_groups(c, n, "c_custkey", [("c_mktsegment", "n_name", "same_segment"), ("c_nationkey", "n_nationkey", "same_nation")])
    return out.select("c_custkey", "same_segment", "same_nation")


@query("SELECT max(l_linenumber) AS last_row FROM lineitem WHERE l_returnflag IS NOT NULL")
def last_row(spark, d):
    """W6."""
    return merge.last_row(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag")


@query("""WITH c AS (SELECT l_orderkey AS id, list({'label': l_linenumber::VARCHAR, 'diagnosis': l_returnflag} ORDER BY l_linenumber, l_returnflag) AS containers FROM lineitem GROUP BY 1)
SELECT id, len(containers) AS n, containers[1].label AS first_label, containers[1].diagnosis AS first_diagnosis, list_filter(containers, lambda x: x.label = '2')[1].diagnosis AS second_diagnosis, list_filter(containers, lambda x: trim(x.diagnosis) <> '')[1].diagnosis AS first_filled FROM c""")
def containers_first(spark, d):
    """J10, J11, J14."""
    l = table(spark, d, "lineitem")
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_linenumber").cast("string").alias("label"), F.col("l_returnflag").alias("diagnosis"))))
    c = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(items, lambda x: F.struct(x["label"].alias("label"), x["diagnosis"].alias("diagnosis"))).alias("containers"))
    kind = F.struct(F.lit("").alias("label"), F.lit("").alias("diagnosis"))
    first = records.container(F.when(F.lit(False), kind), F.lit(False), F.col("containers"))
    return c.select("id", F.size("containers").cast("long").alias("n"), first["label"].alias("first_label"), first["diagnosis"].alias("first_diagnosis"), records.by_label(F.col("containers"), F.lit("2"))["diagnosis"].alias("second_diagnosis"), records.first_filled(F.col("containers"), "diagnosis").alias("first_filled"))


@query("""SELECT event_id, [0, 0, 1, 1, 2, 2, 1, 1, 0][1 + event_id % 9] AS n,
CASE event_id % 9 WHEN 2 THEN event_type WHEN 3 THEN event_id::VARCHAR WHEN 4 THEN event_type WHEN 5 THEN event_type WHEN 6 THEN 'true' WHEN 7 THEN event_type END AS first_label,
CASE event_id % 9 WHEN 4 THEN '2.5' END AS second_label,
CASE event_id % 4 WHEN 0 THEN event_type WHEN 2 THEN 'first' END AS picked FROM events""")
def containers_normalized(spark, d):
    """Containers as null, scalars, arrays of scalars and objects with nulls among them; a container key that is there but null hides the others."""
    e, name = table(spark, d, "events"), F.to_json(F.struct(F.col("event_type").alias("label")))
    quoted = F.concat(F.lit('"'), "event_type", F.lit('"'))
    kinds = [F.lit(None).cast("string"), F.lit("null"), quoted, F.col("event_id").cast("string"), F.concat(F.lit("["), quoted, F.lit(", null, 2.5]")), F.concat(F.lit("[null, "), name, F.lit(', {"label": null, "deep": {"x": [null]}}]')), F.lit("true"), F.col("event_type"), F.lit(" [null] ")]
    made = F.get(F.array(*kinds), (F.col("event_id") % 9).cast("int"))
    records_ = [F.concat(F.lit('{"container": '), name, F.lit(', "containers": [{"label": "first"}]}')), F.lit('{"container": null, "containers": [{"label": "first"}]}'), F.lit('{"containers": [{"label": "first"}, {"label": "second"}]}'), F.lit('{"container": "text", "containers": null}')]
    picked = records.picked_container(F.get(F.array(*records_), (F.col("event_id") % 4).cast("int")))
    many = e.select("event_id", records.normalized_containers(made).alias("many"), picked.alias("own"))
    label = lambda c: F.get_json_object(c, "$.label")
    return many.select("event_id", F.size("many").alias("n"), label(F.get("many", 0)).alias("first_label"), label(F.get("many", 1)).alias("second_label"), label(F.col("own")).alias("picked"))


@query(f"""WITH {_SIMILAR} SELECT query_id, to_json({{'valid_code': code, 'valid_score': similarity}}) AS best, n FROM top JOIN (SELECT query_id, count(*) AS n FROM top GROUP BY 1) USING (query_id) WHERE rank = 1""")
def ranked_map(spark, d):
    """The map for JSON."""
    r = link.ranked(_tops(spark, d), score="similarity").withColumn("m", records.rank_map(F.col("ranked"), "valid"))
    best = F.struct(F.col("m")["top_1"]["valid_code"].alias("valid_code"), records.with_fallback(F.col("ranked"), "score", F.lit(0.0)).alias("valid_score"))
    return r.select("query_id", F.to_json(best).alias("best"), F.size("m").cast("long").alias("n"))


# --- payloads and vocabulary ----------------------------------------------------------------------

def _answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("thinking <unused95>"), "props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here is the result:\n"), "props", F.lit("\nThanks."))).otherwise("not a record")
    return e.select("event_id", "event_type", "user_id", "value", "props", raw.alias("raw") if isinstance(raw, Column) else raw)


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN props END AS payload, event_id % 4 = 3 OR props IS NULL AS failed FROM events")
def json_payload(spark, d):
    """T14."""
    return payload.recover(_answers(spark, d), "raw").select("event_id", "payload", F.col("error").isNotNull().alias("failed"))


_VALID = "value IS NOT NULL AND value >= 0"


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id") % 5
    flag = F.when(k == 0, '"true"').when(k == 1, "1").when(k == 2, "false").when(k == 3, "null").otherwise('"maybe"')
    made = F.concat(F.lit('{"schema_version": "'), F.when(F.col("event_id") % 7 == 0, "v1").otherwise("v5"), F.lit('", "case_id": '), (F.col("event_id").cast("string")), F.lit('.0, "primary_diagnosis": " '), "event_type", F.lit('", "is_definitive": '), flag, F.lit(', "containers": [{"label": "A", "is_lymph_node": 0, "diagnosis": "'), "event_type", F.lit('"}], "has_differential_diagnosis": NaN}'))
    return e.select("event_id", "event_type", F.lit("p").alias("prompt"), F.col("event_id").alias("case_id"), F.col("event_id").alias("report_index"), made.alias("raw"), F.lit(None).cast("string").alias("generation_error"))


@query("""SELECT event_id, event_id % 5 <> 4 AND event_id % 7 <> 0 AS ok, (event_id % 5 = 4)::BIGINT + (event_id % 7 = 0)::BIGINT AS n_errors,
CASE WHEN event_id % 5 <> 4 AND event_id % 7 <> 0 THEN event_id END AS case_id, CASE WHEN event_id % 7 <> 0 THEN CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END END AS is_definitive,
CASE WHEN event_id % 5 <> 4 AND event_id % 7 <> 0 THEN event_type END AS container_diagnosis FROM events""")
def json_validate(spark, d):
    """Versions, lax types, NaN."""
    out = payload.parse(_extracted(spark, d), "raw")
    r = F.col("record")
    return out.select("event_id", (F.size("errors") == 0).alias("ok"), F.size("errors").cast("long").alias("n_errors"), r["case_id"].alias("case_id"), r["is_definitive"].alias("is_definitive"), F.get(r["containers"], 0)["diagnosis"].alias("container_diagnosis"))


@query("""SELECT CASE WHEN event_id % 5 <> 4 AND event_id % 7 <> 0 AND event_type IN ('click', 'view') THEN 'good' ELSE 'broken' END AS outcome, count(*) AS n FROM events GROUP BY 1""")
def dead_letter(spark, d):
    """Good records and broken ones of one pass."""
    done = extraction.validate(_extracted(spark, d), vocabulary=["click", "view"])
    return extraction.outcomes(done).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT event_id, 'primary_diagnosis' AS path, event_type AS term FROM events WHERE event_type NOT IN ('click', 'view') AND event_id % 5 <> 4 AND event_id % 7 <> 0""")
def vocab_violations(spark, d):
    """J2, J3 with an anti-join."""
    out = payload.parse(_extracted(spark, d), "raw").where("record is not null")
    out = out.withColumn("values", payload.constrained_values(F.col("record"), schemas.get("v5")))
    known = spark.range(1).select(F.explode(F.array(F.lit("click"), F.lit(" view "))).alias("term"))
    return payload.violations(out.select("event_id", "values"), "values", known).select("event_id", "path", F.col("outside").alias("term"))


@query("""WITH u AS (SELECT user_id, list(event_type ORDER BY event_id) AS l FROM events GROUP BY 1),
x AS (SELECT user_id, l[1] AS p, unnest(l) AS e, unnest(range(len(l))) AS i FROM u),
y AS (SELECT user_id, e, min(i) AS i FROM x WHERE e <> p GROUP BY 1, 2)
SELECT u.user_id, coalesce(string_agg(e, '|' ORDER BY i), '') AS items, count(e) > 0 AS has_differential FROM u LEFT JOIN y USING (user_id) GROUP BY 1""")
def differential_cleanup(spark, d):
    """J4."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: F.concat(F.lit(" "), s["event_type"])).alias("l"))
    items = payload.differential(F.get("l", 0), F.col("l"))
    return e.select("user_id", F.array_join(items, "|").alias("items"), (F.size(items) > 0).alias("has_differential"))


# --- text --------------------------------------------------------------------------------------

@query("SELECT doc_id, 'Report: ' || text || chr(10) || 'Again: ' || text || chr(10) || chr(10) || 'Allowed diagnosis terms:' || chr(10) || '- a' || chr(10) || '- b' AS prompt FROM documents")
def prompt_fill(spark, d):
    """T11, T12."""
    filled = text.fill_template("Report: {input_text}\nAgain: {input_text}", F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.vocabulary_suffix(filled, ["b", "a", "b"]).alias("prompt"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS words FROM part")
def text_alnum(spark, d):
    """T2; these names have compatibility forms of their own only."""
    return table(spark, d, "part").select("p_partkey", text.alphanumeric(F.concat_ws(" ", "p_name", "p_type")).alias("words"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(lower(text)), '[\x00-\x1F\x7F-\x9F]', ' ', 'g'), '\s+', ' ', 'g')) AS standard FROM documents")
def text_standardize(spark, d):
    """T1 over texts without compatibility forms, which are beyond SQL; ``text_repaired`` has them."""
    return table(spark, d, "documents").select("doc_id", text.standardize(F.col("text")).alias("standard"))


@query("SELECT p_partkey, lower(p_name) || ' é of ' || lower(p_type) || ' 12 fi' AS standard FROM part")
def text_repaired(spark, d):
    """T1 over names with wide letters, a letter and its accent apart, odd spaces, controls, a ligature, and spaces around."""
    made = F.concat(F.lit(" \t"), _wide("p_name"), F.lit(" e\u0301 \x07\u00a0of\u2003"), _wide("p_type"), F.lit("\r\n\uff11\uff12\x85\ufb01 "))
    return table(spark, d, "part").select("p_partkey", text.standardize(made).alias("standard"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN true ELSE false END AS as_number, CASE WHEN toxic = 1 THEN true ELSE false END AS as_word FROM labels")
def bool_coerce(spark, d):
    """T6."""
    word = F.when(F.col("toxic") == 1, " YES ").when(F.col("toxic") == 0, "No")
    return table(spark, d, "labels").select("doc_id", text.truth(F.col("quality")).alias("as_number"), text.truth(word).alias("as_word"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS padded, o_orderkey::VARCHAR AS decimal, 'x' || o_orderkey AS mixed FROM orders")
def case_id_normalize(spark, d):
    """T5."""
    o = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select("o_orderkey", text.case_id(F.concat(F.lit(" 00"), o)).alias("padded"), text.case_id(F.concat(o, F.lit(".0"))).alias("decimal"), text.case_id(F.concat(F.lit("x"), o)).alias("mixed"))


@query("SELECT doc_id, " + ", ".join(f"coalesce(len(regexp_extract_all(text, '{p}')), 0) AS n_{g.lower()}" for g, p, _ in spans.PATTERNS) + " FROM documents")
def phi_counts(spark, d):
    """D2, as counts of each group."""
    found = spans.detect(table(spark, d, "documents").select("doc_id", "text"), "text")

    def own(group: str):
        return lambda s: s["entity_group"] == group

    return found.select("doc_id", *(F.size(F.filter("found", own(g))).cast("long").alias(f"n_{g.lower()}") for g, _, _ in spans.PATTERNS))


@query()
def phi_mask(spark, d):
    """D1-D9, end to end."""
    out = spans.deidentify(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", F.size("spans").alias("n_spans"), "masked")


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\\t\\n\\v\\f\\r ]+') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0), s AS (SELECT doc_id, w, n, unnest(range(0, n, 416)) AS a FROM n)
SELECT doc_id, a // 416 AS "window", least(n, a + 480) - a AS n_tokens, w[a + 1] AS first_token, w[least(n, a + 480)] AS last_token FROM s WHERE a = 0 OR a + 64 < n""")
def chunk_windows(spark, d):
    """D1."""
    out = spans.windows(table(spark, d, "documents").select("doc_id", "text"), "text", token=r"[^\t\n\x0B\f\r ]+")
    tokens = F.regexp_extract_all("window_text", F.lit(r"([^\t\n\x0B\f\r ]+)"))
    return out.select("doc_id", F.col("window").cast("long").alias("window"), F.size(tokens).cast("long").alias("n_tokens"), F.get(tokens, 0).alias("first_token"), F.element_at(tokens, -1).alias("last_token"))


@query("SELECT arg_min(page_id, page_id) AS page_id, url FROM pages WHERE url IS NOT NULL GROUP BY url")
def url_first_section(spark, d):
    """S13."""
    return readers.first_by(table(spark, d, "pages").select("page_id", "url"), "url", "page_id")


@query(f"WITH {_SIMILAR} SELECT query_id, entry_id, similarity FROM k WHERE rn <= 2")
def rag_topk(spark, d):
    """The two nearest."""
    c = _candidates(spark, d)
    return c.withColumn("rn", F.row_number().over(_by("query_id", F.desc("similarity"), F.asc("entry_id")))).where("rn <= 2").select("query_id", "entry_id", "similarity")


@query("SELECT run, metric, value FROM (SELECT 'n' AS run, 'conversations' AS metric, count(DISTINCT conv_id)::DOUBLE AS value FROM conversations UNION ALL SELECT 'n', 'turns', count(*)::DOUBLE FROM conversations UNION ALL SELECT 'n', 'answered', avg((role = 'assistant')::INT) FROM conversations)")
def conversation_metrics(spark, d):
    """A3-style bundle over conversation logs, as rows."""
    c = table(spark, d, "conversations").agg(F.count_distinct("conv_id").alias("conversations"), F.count("*").alias("turns"), metrics.accuracy(F.col("role") == "assistant").alias("answered"))
    return metrics.melt(c, "n")
