"""JSON out of model answers, and records out of JSON.

Spark's JSON functions accept trailing text, and are strict on types; the records' rules are the
other way round.  So whether text is JSON is decided by one vectorised Python function, and types are coerced from
text by plain expressions.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook import schemas

#: Fixed value: what ends a model's reasoning.
REASONING_END = "<unused95>"
PREVIEW = 1024


def _is_json(text: str | None) -> bool:
    try:
        json.loads(text or "")
    except ValueError:
        return False
    return True


def is_json(text: Column | str) -> Column:
    """Whether all of a text is JSON."""

    @F.pandas_udf("boolean")
    def run(part: pd.Series) -> pd.Series:
        return part.map(_is_json)

    return run(text)


def candidates(raw: Column, reasoning_end: str | None = REASONING_END) -> tuple[Column, Column]:
    """What may be the JSON of an answer: all of it without reasoning and fences, and from its first { to its last }."""
    text = F.coalesce(raw, F.lit(""))
    if reasoning_end:
        text = F.substring_index(text, reasoning_end, -1)
    text = F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    text = F.regexp_replace(text, r"(?s)^```[A-Za-z]*\s*|\s*```$", "")
    return text, F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def recover(df: DataFrame, raw: str, payload: str = "payload", error: str = "error", reasoning_end: str | None = REASONING_END) -> DataFrame:
    """``df`` with the JSON text of column ``raw``, or an error with the answer's beginning."""
    whole, inner = candidates(F.col(raw), reasoning_end)
    out = df.withColumns({"_whole": whole, "_inner": inner})
    found = F.when(is_json("_whole"), F.col("_whole")).when(is_json("_inner"), F.col("_inner"))
    preview = F.replace(F.substring(F.col(raw), 1, PREVIEW), F.lit("\n"), F.lit("\\n"))
    out = out.withColumn(payload, found)
    return out.withColumn(error, F.when(F.col(payload).isNull(), F.concat(F.lit("Invalid JSON: "), F.coalesce(preview, F.lit(""))))).drop("_whole", "_inner")


def _loose(kind: T.DataType) -> T.DataType:
    """The same shape with text for every scalar."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_loose(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in kind.fields])
    return T.StringType()


def _coerced(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _coerced(x, kind.elementType))
    if isinstance(kind, T.StructType):
        made = F.struct(*(_coerced(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.StringType):
        return F.when(~value.isin('"NaN"', "NaN"), value)
    text = F.lower(F.trim(value))
    if isinstance(kind, T.BooleanType):
        return F.when(text.isin("true", "1", "1.0", "yes", "y", "on", "t"), True).when(text.isin("false", "0", "0.0", "no", "n", "off", "f"), False)
    number = F.when(~text.isin("nan", '"nan"'), text.try_cast("double"))
    if isinstance(kind, T.LongType):
        return F.when(number == F.floor(number), number.try_cast("bigint"))
    return number


def _failures(value: Column, typed: Column, kind: T.DataType, path: Column) -> Column:
    """Paths of scalars that have text but no value of their kind."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.ArrayType):
        each = F.transform(F.coalesce(value, F.array().cast(_loose(kind))), lambda x, k: _failures(x, F.get(typed, k), kind.elementType, F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))
        return F.flatten(each)
    if isinstance(kind, T.StructType):
        parts = [_failures(value[f.name], typed[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields if not isinstance(f.dataType, T.StringType)]
        return reduce(lambda a, b: F.concat(a, b), parts, none)
    if isinstance(kind, T.StringType):
        return none  # any text is one
    wrong = value.isNotNull() & typed.isNull() & ~F.lower(F.trim(value)).isin("nan", '"nan"')
    return F.when(wrong, F.array(path)).otherwise(none)


def parse(df: DataFrame, payload: str, version: str = schemas.DEFAULT, record: str = "record", errors: str = "errors") -> DataFrame:
    """``df`` with a typed record of the JSON text in ``payload`` and a list of what is wrong with it.

    Text and numbers are taken for booleans and integers where they plainly are such.  A
    record with errors is null.
    """
    schema = schemas.get(version)
    raw = F.from_json(payload, _loose(schema))
    # The row's number is not deterministic, so no filter on the outcome moves below the parse and repeats it.
    out = df.withColumns({"_raw": raw, "_row": F.monotonically_increasing_id()})
    loose = F.col("_raw")
    out = out.withColumn("_typed", _coerced(loose, schema))
    wrong = F.transform(_failures(loose, F.col("_typed"), schema, F.lit("")), lambda p: F.concat(F.lit("Schema mismatch: "), F.substring(p, 2, 1000)))
    checks = [F.when(F.col(payload).isNull() | ~F.trim(payload).startswith("{") | loose.isNull() | (F.col("_row") < 0), F.lit("Invalid JSON"))]
    checks.append(F.when(F.coalesce(loose["schema_version"], F.lit(version)) != version, F.concat(F.lit("Schema mismatch: schema_version is "), loose["schema_version"])))
    if "confidence" in schema.names:
        confidence = loose["confidence"].try_cast("double")
        checks.append(F.when((confidence < 0) | (confidence > 1), F.lit("Schema mismatch: confidence")))
    if "differential_diagnoses" in schema.names:
        checks.append(F.when(F.size(loose["differential_diagnoses"]) > schemas.MOST_DIFFERENTIALS, F.lit("Schema mismatch: differential_diagnoses")))
    out = out.withColumn(errors, F.array_compact(F.concat(F.array(*checks), F.coalesce(wrong, F.array().cast("array<string>")))))
    typed = F.col("_typed").withField("schema_version", F.lit(version))
    return out.withColumn(record, F.when(F.size(errors) == 0, typed)).drop("_raw", "_row", "_typed")


def constrained_values(record: Column, schema: T.StructType) -> Column:
    """(path, term) of every value held to the vocabulary, trimmed, without blanks."""
    kind = "array<struct<path:string,term:string>>"

    def pair(path: Column, term: Column) -> Column:
        return F.struct(path.alias("path"), F.trim(term).alias("term"))

    parts = []
    for path in schemas.constrained_paths(schema):
        value, field = record[path[0]], schema[path[0]]
        if isinstance(field.dataType, T.ArrayType):
            name = path[0]

            def item(x: Column, k: Column, path=path, name=name) -> Column:
                at = F.concat(F.lit(f"{name}["), k.cast("string"), F.lit("".join(["]", *(f".{p}" for p in path[1:])])))
                return pair(at, reduce(lambda c, p: c[p], path[1:], x))

            def each(x, k):
                return item(x, k)

            parts.append(F.transform(F.coalesce(value, F.array().cast(field.dataType)), each))
        else:
            parts.append(F.array(pair(F.lit(".".join(path)), reduce(lambda c, p: c[p], path[1:], value))))
    values = F.concat(*parts) if parts else F.array()
    return F.filter(values.cast(kind), lambda v: F.coalesce(v["term"] != "", F.lit(False)))


def outside_vocabulary(values: Column, terms: list[str]) -> Column:
    """Those of ``constrained_values`` whose term is not in a small vocabulary."""
    allowed = F.array(*(F.lit(t) for t in sorted(set(terms)))).cast("array<string>")
    return F.filter(values, lambda v: ~F.array_contains(allowed, v["term"]))


def violations(df: DataFrame, values: str, vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """J3 for a vocabulary of any size: a row of ``df`` for each value outside it, with path and term."""
    rows = df.select("*", F.explode(values).alias("_v")).select("*", F.col("_v.path").alias("path"), F.col("_v.term").alias("outside")).drop("_v")
    known = vocabulary.select(F.trim(term).alias("_known")).where("_known <> ''").distinct()
    return rows.join(known, F.col("outside") == F.col("_known"), "left_anti")


def differential(primary: Column, items: Column) -> Column:
    """Items trimmed, without blanks and the primary, each once, in order."""
    trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: F.coalesce(x != "", F.lit(False)) & ~F.coalesce(x == F.trim(primary), F.lit(False))))
