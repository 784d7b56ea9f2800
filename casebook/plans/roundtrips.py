"""Queries of the readers and sinks: tables of the driver are written by a sink and read back by a reader (S1-S12, K1-K9, T7-T9, T13, T15), and of what lies around them.

Each has DuckDB SQL for what was written, so a difference is the fault of either side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook import schemas
from casebook.functions import text
from casebook.operators import compare, dictionary, extraction, runs
from casebook.plans import linking
from casebook.plans.catalogue import table
from casebook.sources import readers, sinks, work

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS case_id, trim(p_name) AS text FROM part WHERE p_partkey % 5 <> 0")
def scan_reports(spark, d):
    """A sheet as CSV, with blank texts, ids as decimals and headers in odd case."""
    p = table(spark, d, "part")
    number = F.when(F.col("p_partkey") % 7 != 0, F.concat(F.col("p_partkey").cast("string"), F.lit(".0")))
    made = p.select(number.alias(" number "), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise("  ").alias("FINAL Diagnosis"))
    folder = work.new_folder(spark, "reports")
    sinks.csvs({"sheet.csv": made}, folder)
    return readers.load_reports(spark, f"{folder}/sheet.csv").select("case_id", "text")


@query("SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS case_id, trim(p_name) AS text FROM part WHERE p_partkey % 5 <> 0")
def scan_workbook(spark, d):
    """A sheet as a workbook, written and read by tasks, with blank texts, gaps in its ids and headers in odd case."""
    p = table(spark, d, "part")
    made = p.select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey").cast("double")).alias(" number "), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("FINAL Diagnosis"), (F.col("p_size") > 10).alias("large"))
    path = work.new_folder(spark, "workbook") + ".xlsx"
    sinks.reset(spark, path.rpartition("/")[0])
    sinks.workbook(made, path)
    return readers.load_reports(spark, path, "*").select("case_id", "text")  # a large table takes several sheets


@query("SELECT row_number() OVER () AS report_index, p_name AS text FROM (SELECT DISTINCT p_name FROM part ORDER BY 1)")
def scan_lines(spark, d):
    """A text file with blank lines, one report a line, numbered in order."""
    names = table(spark, d, "part").select(F.explode(F.array("p_name", F.concat("p_name", F.lit(" ")))).alias("value")).distinct().orderBy(F.trim("value"), F.length("value"))
    folder = work.new_folder(spark, "lines") + ".txt"
    names.select(F.when(F.col("value").endswith(" "), "  ").otherwise(F.col("value")).alias("value")).coalesce(1).write.text(folder)
    return readers.load_reports(spark, folder).select("report_index", "text")


_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


@query("SELECT event_id, event_type, value FROM events")
def scan_jsonl(spark, d):
    """Records as JSON lines, nulls kept, and back; appended in two writes."""
    folder = work.new_folder(spark, "records")
    sinks.reset(spark, folder)
    for half in (0, 1):
        e = table(spark, d, "events").where(F.col("event_id") % 2 == half)
        sinks.records(e.select(F.struct("event_id", "event_type", "value").alias("record")), folder)
    return readers.jsonl(spark, f"{folder}/predictions", _EVENT)


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def scan_json_array(spark, d):
    """One JSON array, by suffix."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    folder = work.new_folder(spark, "array") + ".json"
    n.agg(F.to_json(F.collect_list(F.struct("key", "name"))).alias("value")).write.text(folder)
    return readers.records(spark, folder, T.StructType([T.StructField("key", T.LongType()), T.StructField("name", T.StringType())]))


@query("SELECT user_id::VARCHAR AS case_id, arg_max(event_type, event_id) AS last_type, row_number() OVER (ORDER BY min(event_id)) AS place FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def scan_keyed(spark, d):
    """Keyed JSON lines, ids as decimals, blank lines; the last line of an id wins, in the order of first ones."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id").isNotNull(), F.concat(F.col("user_id").cast("string"), F.lit(".0"))).alias("case_id"), "event_type")
    line = F.when(F.col("event_id") >= 0, F.to_json(F.struct("case_id", "event_type")))
    lines = e.select("event_id", F.explode(F.array(line, F.lit(" "))).alias("value")).orderBy("event_id", F.desc("value"))
    folder = work.new_folder(spark, "keyed") + ".jsonl"
    lines.select("value").coalesce(1).write.text(folder)
    keyed = readers.placed(readers.keyed_jsonl(spark, folder), "first_line", "place")
    return keyed.select("case_id", F.get_json_object("value", "$.event_type").alias("last_type"), "place")


@query("SELECT run, metric, value FROM (SELECT 'run_' || l_returnflag AS run, count(*)::DOUBLE AS n, avg(l_quantity)::DOUBLE AS mean FROM lineitem GROUP BY 1) UNPIVOT INCLUDE NULLS (value FOR metric IN (n, mean)) UNION ALL SELECT 'run_' || l_returnflag, 'absent', NULL FROM lineitem GROUP BY 1")
def scan_metrics(spark, d):
    """A summary of each run as JSON in its folder, and metrics by the folder's name."""
    folder = work.new_folder(spark, "runs")
    wide = table(spark, d, "lineitem").groupBy(F.concat(F.lit("run_"), "l_returnflag").alias("run")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"))
    sinks.csvs({"summaries": wide}, folder)
    wide = readers.csv(spark, f"{folder}/summaries", wide.schema)
    for run in [r["run"] for r in wide.select("run").collect()]:  # a folder for each run, as runs leave them
        sinks.summary_json(wide.where(F.col("run") == run).select("n", "mean"), f"{folder}/{run}")
    return readers.metrics(spark, [f"{folder}/run_*"], ["n", "mean", "absent"])


@query("SELECT c_custkey, c_name, c_acctbal, c_custkey % 2 = 0 AS flag, '[\"' || c_mktsegment || '\"]' AS parts FROM customer")
def scan_csv(spark, d):
    """An output as CSV, nested columns as JSON, read by its schema; an output that is not wanted is not written."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 2 == 0).alias("flag"), F.array("c_mktsegment").alias("parts"))
    folder = work.new_folder(spark, "csv")
    sinks.csvs({"wanted": c, "unwanted": c}, folder, {"wanted"})
    schema = T.StructType([f if f.name != "parts" else T.StructField("parts", T.StringType()) for f in c.schema.fields])
    return readers.csv(spark, f"{folder}/wanted", schema)


@query("SELECT CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE 'report_' || event_id END AS case_id, event_type AS diagnosis, true AS indented, 'Text: ' || event_type AS prompt FROM events")
def case_files(spark, d):
    """K2, K3: an indented JSON file and a prompt file of each case; rows without a case go by their report."""
    e = table(spark, d, "events")
    record = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("case_id"), F.col("event_type").alias("primary_diagnosis"), F.lit(None).cast("string").alias("nothing"))
    folder = work.new_folder(spark, "cases")
    sinks.case_archives(e.select(record.alias("record"), F.col("event_id").alias("report_index"), F.concat(F.lit("Text: "), "event_type").alias("prompt")), folder)
    named = readers.archives(spark, folder).select(F.regexp_extract("name", r"^case_(.*)\.(json|txt)$", 1).alias("case_id"), F.regexp_extract("name", r"[^.]*$", 0).alias("kind"), "content")
    files = named.groupBy("case_id").agg(F.max(F.when(F.col("kind") == "json", F.col("content"))).alias("json"), F.max(F.when(F.col("kind") == "txt", F.col("content"))).alias("prompt"))
    return files.select("case_id", F.get_json_object("json", "$.primary_diagnosis").alias("diagnosis"), F.contains("json", F.lit("\n")).alias("indented"), "prompt")


@query("SELECT event_id AS report_index, 'generation: ' || event_type AS error, NULL::VARCHAR AS raw_output FROM events")
def dead_letters(spark, d):
    """K4: broken records appended, and back."""
    e = table(spark, d, "events")
    folder = work.new_folder(spark, "broken")
    rows = e.select(F.array(F.concat(F.lit("generation: "), "event_type")).alias("errors"), F.lit(None).cast("string").alias("raw"), F.col("event_id").alias("report_index"))
    for half in (0, 1):
        sinks.broken(extraction.split(rows.where(F.col("report_index") % 2 == half))[1], folder)
    return spark.read.schema("report_index long, error string, raw_output string").json(f"{folder}/broken")


@query("SELECT vec_id, len(embedding) AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vector_sink(spark, d):
    """K9: a vector table of checked width."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    path = work.new_folder(spark, "vectors")
    sinks.vectors(e, path, "embedding", len(e.first()["embedding"]))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(total, 4).alias("total"))


@query("SELECT doc_id, 'Q: ' || text || chr(10) || chr(10) || 'Answer with one JSON object and nothing else.' AS guarded, '<u>' || text || chr(10) || chr(10) || 'Answer with one JSON object and nothing else.' || '</u>' AS chat FROM documents")
def prompt_guard(spark, d):
    """T13."""
    prompt = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.json_only(F.concat(F.lit("Q: "), prompt)).alias("guarded"), text.json_only(prompt, "<u>{prompt}</u>").alias("chat"))


@query("SELECT page_id, split_part(url, '/', -2) AS run FROM pages WHERE len(string_split(url, '/')) > 1")
def run_names(spark, d):
    """T15."""
    p = table(spark, d, "pages").where("size(split(url, '/')) > 1")
    return p.select("page_id", text.run_name(F.col("url")).alias("run"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def first_rows(spark, d):
    """Rows flagged as the first of their case."""
    from casebook.operators import merge
    from casebook.plans import catalogue

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", catalogue._row_order().alias("place"))
    return compare.first_rows(merge.first_occurrence(rows, "l_orderkey", "place"), "is_first").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH t AS (SELECT count(DISTINCT p_type) AS n, min(p_type) AS first_term, max(p_type) AS last_term FROM part),
f AS (SELECT * FROM (VALUES ('primary_diagnosis', true), ('is_definitive', false), ('containers', false), ('containers.label', false), ('containers.is_lymph_node', false), ('containers.diagnosis', true),
  ('has_differential_diagnosis', false), ('has_prior_malignancy', false), ('has_concurrent_malignancy', false)) v(field, held))
SELECT field, CASE WHEN held THEN n ELSE 0 END AS n_terms, CASE WHEN held THEN first_term END AS first_term, CASE WHEN held THEN last_term END AS last_term FROM f, t""")
def decoder_schema(spark, d):
    """The schema sent to an endpoint: no hidden field, everything required, the terms of a table's vocabulary as choices."""
    terms = [r[0] for r in dictionary.terms(table(spark, d, "part"), "p_type").collect()]  # a vocabulary is a constant of the decoder
    made = extraction.decoder("schema", "http", "v7", terms)

    def fields(schema: dict, path: str = ""):
        for name in schema["required"]:
            kind = schema["properties"][name].get("anyOf", [schema["properties"][name]])[0]
            yield path + name, kind.get("enum", [])
            yield from fields(kind.get("items", {"required": []}), f"{path}{name}.")

    rows = [(n, len(c), min(c, default=None), max(c, default=None)) for n, c in fields(made) if n != "schema_version"]
    return spark.createDataFrame(rows, "field string, n_terms int, first_term string, last_term string")


def _answered(spark, d) -> DataFrame:
    """Events as reports whose text is an answer: every third gives no record."""
    answer = F.when(F.col("event_id") % 3 == 0, "no record").otherwise(F.to_json(F.struct(F.col("event_type").alias("primary_diagnosis"))))
    return table(spark, d, "events").select(F.col("event_id").alias("report_index"), F.col("event_id").alias("case_id"), answer.alias("text"))


@query("SELECT outcome, count(*) AS n, count(*) AS n_handled, min(event_id) AS first FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'broken' ELSE 'good' END AS outcome FROM events) GROUP BY 1")
def extraction_run(spark, d):
    """A run over an adapter made by name; its handlers write good and broken records, which are counted as they are read back."""
    folder = work.new_folder(spark, "run")
    good, broken = extraction.run(
        _answered(spark, d), "{input_text}", extraction.backend(" Echo "), f"{folder}/answers",
        on_success=lambda df: sinks.records(df, folder), on_error=lambda df: sinks.broken(df, folder),
    )
    handled = spark.read.text(f"{folder}/predictions").select(F.lit("good").alias("outcome")).union(spark.read.text(f"{folder}/broken").select(F.lit("broken")))
    made = good.select("report_index", F.lit("good").alias("outcome")).union(broken.select("report_index", F.lit("broken")))
    return made.groupBy("outcome").agg(F.count("*").alias("n"), F.min("report_index").alias("first")).join(handled.groupBy("outcome").agg(F.count("*").alias("n_handled")), "outcome")


@query("SELECT event_id AS report_index, CASE WHEN event_id % 3 = 0 THEN 'broken' ELSE 'good' END AS outcome, CASE WHEN event_id % 3 <> 0 THEN event_type END AS diagnosis, 1 AS n_answers FROM events")
def resumed_run(spark, d):
    """A run that stops after two of its batches and goes on in another; each report is answered once."""
    folder, reports = work.new_folder(spark, "resumed"), _answered(spark, d)
    size = max(1, reports.count() // 5)
    for most in (2, None):  # stopped, and resumed
        runs.resume(reports, "{input_text}", extraction.backend("echo"), folder, size=size, most=most)
    done = runs.answers(spark, folder)
    every = spark.read.parquet(f"{folder}/answers").groupBy("report_index").agg(F.count("*").cast("int").alias("n_answers"))
    broken = F.size("errors") > 0
    return done.select("report_index", F.when(broken, "broken").otherwise("good").alias("outcome"), F.col("record.primary_diagnosis").alias("diagnosis")).join(every, "report_index")


@query("SELECT p_partkey, replace(lower(p_type), ' ', '_') || CASE WHEN p_size % 3 = 0 THEN '' ELSE '_' || replace(replace(lower(p_brand), ' ', '_'), '/', '_') || '_of_' || p_size END AS slug, p_retailprice AS price FROM part")
def metric_names(spark, d):
    """Names out of display names of rows, and a column by its display name, in a sheet with odd headers."""
    sheet = table(spark, d, "part").withColumnRenamed("p_retailprice", " Retail Price ").withColumnRenamed("p_type", "TYPE")
    price, kind = (text.header(sheet.columns, n) for n in ("retail price", " type "))
    brand = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(" "), "p_brand", F.lit("/of "), "p_size"))
    return sheet.select("p_partkey", text.slugged(F.col(kind), brand, F.lit(" ")).alias("slug"), F.col(f"`{price}`").alias("price"))


@query("""WITH last AS (SELECT p_type AS name, arg_max(p_brand, p_partkey) AS brand, arg_max(p_size, p_partkey)::BIGINT AS code FROM part GROUP BY 1),
first AS (SELECT p_size::BIGINT AS code, arg_min(p_brand, p_partkey) AS group_1 FROM part GROUP BY 1)
SELECT o.o_orderkey AS key, l.code, f.group_1, CASE WHEN l.code IS NULL THEN 0 ELSE 1 END AS n_primary, 2 AS n_containers, l.code AS container_code, f.group_1 AS container_group, 0 AS n_second FROM orders o
LEFT JOIN (SELECT p_partkey, p_type FROM part) p ON p.p_partkey = o.o_custkey LEFT JOIN last l ON l.name = p.p_type LEFT JOIN first f USING (code)""")
def link_records_exact(spark, d):
    """Records with a primary text and two containers, linked by equal names, each distinct text once."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    entries = p.select(F.col("p_size").cast("long").alias("code"), F.col("p_type").alias("name"), F.col("p_brand").alias("group_1"), F.col("p_partkey").alias("row_num"))
    own = table(spark, d, "orders").join(p, F.col("o_custkey") == F.col("p_partkey"), "left")
    nested = F.array(*(F.struct(F.col(c).alias("diagnosis")) for c in ("p_type", "o_orderstatus")))
    records = own.select(F.col("o_orderkey").alias("key"), F.col("p_type").alias("primary_diagnosis"), nested.alias("containers"))
    out = linking.link_records(records, "key", entries, exact=True)
    first, own = F.get("ranked", 0), F.get(F.get("container_ranked", 0), 0)
    return out.select("key", first["code"].alias("code"), first["group_1"].alias("group_1"), F.size("ranked").alias("n_primary"), F.size("container_ranked").alias("n_containers"),
                      own["code"].alias("container_code"), own["group_1"].alias("container_group"), F.size(F.get("container_ranked", 1)).alias("n_second"))


@query("SELECT 'v5' AS version, 2 AS k, 'Text: ' || r_name AS prompt FROM region")
def configured_prompt(spark, d):
    """Settings over defaults from a file, and the template of a version.  Both are small files of the driver's."""
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "config.yaml").write_text('{"version": "v5", "k": 2}', encoding="utf-8")
        Path(folder, "extraction_v5.txt").write_text("Text: {input_text}", encoding="utf-8")
        settings = readers.config(f"{folder}/config.yaml", {"version": "v2", "k": 1}, {"version": set(schemas.VERSIONS)})
        template = readers.prompt_template(folder, settings["version"])
    return extraction.prompts(table(spark, d, "region"), template, "r_name").select(F.lit(settings["version"]).alias("version"), F.lit(settings["k"]).alias("k"), "prompt")
