"""Scans (S1-S13).  Schemas are explicit."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.functions.text import case_id, header, run_name
from casebook.sources import sheets


def workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet with every cell as text and ``row_num`` from 1, parsed by tasks."""
    spark.dataSource.register(sheets.SheetSource)
    return spark.read.format(sheets.FORMAT).option("sheet", str(sheet)).load(path)


def sheet(spark: SparkSession, path: str, sheet_name: str | int = 0) -> DataFrame:
    """A workbook, or CSV with a header, or Parquet, by suffix."""
    suffix = Path(path).suffix.lower()
    if suffix == ".xlsx":
        return workbook(spark, path, sheet_name)
    if suffix == ".csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return spark.read.parquet(path)


def require(df: DataFrame, *names: str) -> list[str]:
    """The columns that display names mean; missing ones are an error that lists them."""
    found = {n: header(df.columns, n) for n in names}
    missing = [n for n, c in found.items() if c is None]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return [found[n] for n in names]


def not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows with their place in the scan, from 1.

    Places within partitions are known where the rows are; what is counted and broadcast is one row for each partition.  Both passes must find
    the same rows in the same partitions, as they do in files; what a sort or another shuffle has dealt is for ``placed``.
    """
    here = df.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = here.groupBy("_part").agg((F.max("_at") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = here.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_offset") + F.col("_at") + 1).drop("_id", "_part", "_at", "_offset")


def placed(df: DataFrame, by: str, name: str, each: int = 1 << 16) -> DataFrame:
    """Rows with their place, from 1, in the order of ``by``, whole numbers that no two rows share, such as those of lines.

    Ranges of ``each`` numbers are counted, one row for each is broadcast, and rows are numbered within their range.
    """
    cut = df.withColumn("_range", F.floor(F.col(by) / F.lit(each)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = cut.join(F.broadcast(offsets), "_range").withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(by)))
    return out.withColumn(name, F.col("_offset") + F.col("_at")).drop("_range", "_offset", "_at")


def reports(df: DataFrame, id_column: str = "Number", text_column: str = "Final Diagnosis") -> DataFrame:
    """(case_id, report_index, text) of a sheet: rows without text go, ids are whole numbers or an error, texts trimmed."""
    id_col, text_col = require(df, id_column, text_column)
    text = F.regexp_replace(F.col(text_col).cast("string"), r"(?U)^\s+|\s+$", "")
    key = F.nullif(F.trim(F.col(id_col).cast("string")), F.lit(""))
    number = key.try_cast("double")
    whole = F.when(key.isNull(), F.lit(None)).when(number == F.floor(number), number.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), key)).cast("bigint"))
    kept = df.withColumn("_text", text).where(F.coalesce(F.col("_text") != "", F.lit(False)))
    return numbered(kept.select(whole.alias("case_id"), F.col("_text").alias("text")), "report_index").select("case_id", "report_index", "text")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A report on each line that is not blank."""
    raw = spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text")).where("text <> ''")
    return numbered(raw, "report_index").select(F.lit(None).cast("bigint").alias("case_id"), "report_index", "text")


def load_reports(spark: SparkSession, path: str, sheet_name: str | int = 0) -> DataFrame:
    """Reports of a workbook, CSV or Parquet sheet, or of a text file, by suffix; none at all is an error.  The ``sheet_name`` ``*`` is all sheets of a workbook."""
    found = lines(spark, path) if Path(path).suffix.lower() in (".txt", "") else reports(sheet(spark, path, sheet_name))
    return not_empty(found, "reports")


def terms(df: DataFrame, column: str = "Diagnosis") -> DataFrame:
    """S3: distinct trimmed values that are not blank."""
    (name,) = require(df, column)
    return df.select(F.trim(name).alias("term")).where("term <> ''").distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with ``line``, which grows in the order of the files and, in each, of its lines."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines; a line that is none is an error when it is read, blank ones are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def keyed_jsonl(spark: SparkSession, path: str, id_field: str = "case_id") -> DataFrame:
    """(case_id, first_line, value) of JSON lines: each id's last object, in the order in which ids came first.

    Blank lines are skipped, lines that are no JSON object are an error with their number and text, and objects without an id go.
    """
    raw = numbered(spark.read.text(path), "line").where("trim(value) <> ''")
    good = F.expr("try_parse_json(value)").isNotNull() & F.trim("value").startswith("{")
    checked = raw.withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line"), F.lit(" is not a JSON object: "), F.substring("value", 1, 200))).cast("string")))
    keyed = checked.withColumn("case_id", case_id(F.get_json_object("value", f"$.{id_field}"))).where("case_id is not null")
    return keyed.groupBy("case_id").agg(F.min("line").alias("first_line"), F.max(F.struct("line", "value"))["value"].alias("value"))


def records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines (.jsonl) or of one JSON array (.json)."""
    suffix = Path(path).suffix.lower()
    if suffix not in (".jsonl", ".json"):
        raise ValueError(f"neither JSON lines nor JSON: {path}")
    return spark.read.schema(schema).option("multiLine", suffix == ".json").option("mode", "FAILFAST").json(path)


def _plain_members(raw: bytes) -> list[tuple[str, str]] | None:
    """Files of a tar archive with plain headers only, else None."""
    out, at = [], 0
    while at < len(raw):
        kind, size = raw[at + 156 : at + 157], raw[at + 124 : at + 135]
        if kind not in (b"0", b"5") or raw[at + 257 : at + 262] != b"ustar" or raw[at + 345] or not size.isdigit():
            return None
        n = int(size, 8)
        if kind == b"0":
            out.append((raw[at : at + 100].rstrip(b"\0").decode(), raw[at + 512 : at + 512 + n].decode()))
        at += 512 + -(-n // 512) * 512
    return out


def _files(batches):
    import gzip
    import io
    import tarfile

    import pandas as pd

    for pdf in batches:
        for raw in pdf["content"]:
            raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            files = _plain_members(raw)
            if files is None:
                with tarfile.open(fileobj=io.BytesIO(raw)) as archive:
                    files = [(m.name, archive.extractfile(m).read().decode()) for m in archive if m.isfile()]
            yield pd.DataFrame(files, columns=["name", "content"])


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the files in the tar archives that ``sinks.case_archives`` wrote."""
    found = spark.read.format("binaryFile").load(f"{folder}/archives/part-*").select("content")
    return found.mapInPandas(_files, "name string, content string")


def metrics(spark: SparkSession, paths: list[str], names: list[str]) -> DataFrame:
    """(run, metric, value) of summary files; metrics that a file lacks are null."""
    whole = spark.read.text(paths, wholetext=True).select(run_name(F.col("_metadata.file_path")).alias("run"), "value")
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.get_json_object("value", f"$['{n}']").try_cast("double").alias("value")) for n in names))
    return whole.select("run", F.explode(pairs).alias("p")).select("run", "p.metric", "p.value")


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An earlier output, by its schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def config(path: str, known: dict[str, object], choices: dict[str, set] | None = None) -> dict:
    """Settings of a YAML or JSON file over defaults; unknown keys and values outside choices are errors."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        given = yaml.safe_load(text) or {}
    except ImportError:
        given = json.loads(text)
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    merged = known | given
    for key, allowed in (choices or {}).items():
        if merged.get(key) not in allowed:
            raise ValueError(f"{key} is {merged.get(key)!r}; allowed: {sorted(map(str, allowed))}")
    return merged


def prompt_template(folder: str, version: str) -> str:
    """The text of prompt_<version>.txt, or else extraction_<version>.txt."""
    for name in (f"prompt_{version}.txt", f"extraction_{version}.txt"):
        if (found := Path(folder) / name).exists():
            return found.read_text(encoding="utf-8")
    raise FileNotFoundError(f"no prompt template {version} in {folder}")


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key that is not null, by an aggregation that reduces before it shuffles."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_picked")).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def sections(df: DataFrame, text: str) -> DataFrame:
    """A row for each section of a Markdown text, split before its headings, with ``section`` from 0."""
    parts = F.filter(F.split(text, r"(?m)(?=^#{1,6} )"), lambda s: F.trim(s) != "")
    return df.select("*", F.posexplode(parts).alias("section", "section_text"))

