"""Positional merge of predictions into a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.text import same_key
from casebook.operators.confusion import literal_match


#: Parts that rows without a key are dealt to.
PARTS = 64


def positional(sheet: DataFrame, records: DataFrame, case: str, row: str, containers: str, fields: list[str], case_fields: dict[str, str] | None = None) -> DataFrame:
    """The i-th row of a case gets its i-th container; more containers become new rows, fewer leave nulls.

    Rows of cases without a record stay as they are.  Each record is one row with an array of
    containers; ``case_fields`` are record columns to put on the sheet's own rows, not on new ones.  ``ordinal`` is the place in
    the case, from 1, and ``inserted`` tells new rows.  ``row`` tells the order, as a number or a struct.  Sheet and records are read once each.
    """
    case_fields = case_fields or {}
    # rows without a case are dealt to parts, or all of them would be one case; they meet no record
    salt = F.when(F.col(case).isNull(), F.pmod(F.xxhash64(row), F.lit(PARTS)))
    place = F.row_number().over(Window.partitionBy(case, salt).orderBy(row))
    own = sheet.withColumn("_salt", salt).withColumn("ordinal", F.when(F.col(case).isNull(), F.lit(1)).otherwise(place))
    own = own.withColumn("_at", F.coalesce(-1 - F.col("_salt"), F.col("ordinal").cast("long")))
    # a record without containers still has a row, at 0, for its fields
    each = records.select(F.col(case).alias("_key"), *(F.col(v).alias(f"_case_{k}") for k, v in case_fields.items()), F.posexplode_outer(containers).alias("_pos", "_c"))
    each = each.withColumn("_ordinal", F.coalesce(F.col("_pos") + 1, F.lit(0))).select("*", *(F.col(f"_c.{f}").alias(f"_{f}") for f in fields)).drop("_pos", "_c")
    out = own.join(each, (F.col(case) == F.col("_key")) & (F.col("_at") == F.col("_ordinal")), "full_outer")
    whole = Window.partitionBy(F.coalesce(F.col(case), F.col("_key")), "_salt")
    inserted = F.col("ordinal").isNull()
    out = out.withColumns({"_known": F.max(~inserted).over(whole), **{f"_case_{k}": F.first(f"_case_{k}", ignorenulls=True).over(whole) for k in case_fields}})
    out = out.where(~inserted | (F.col("_known") & (F.col("_ordinal") > 0)))  # containers of cases that the sheet lacks go
    return out.select(
        F.coalesce(F.col(case), F.col("_key")).alias(case),
        *[c for c in sheet.columns if c != case],
        F.coalesce("ordinal", "_ordinal").alias("ordinal"),
        inserted.alias("inserted"),
        *(F.col(f"_{f}").alias(f) for f in fields),
        *(F.when(~inserted, F.col(f"_case_{k}")).alias(k) for k in case_fields),
    )


def sheet_order(case: str, row: str) -> list[Column]:
    """Rows in the sheet's order, inserted ones after their case's last: sort by these."""
    first = F.min(row).over(Window.partitionBy(case))
    return [first, F.col("ordinal")]


def first_occurrence(df: DataFrame, key: str, row: str, flag: str = "is_first") -> DataFrame:
    """Whether a row, of which ``row`` is the number, or a struct to order by, is its key's first; true for a null key only where it is the first null.

    First rows are found by an aggregation, so that a key with very many rows is reduced before it is shuffled, and joined back; rows
    without a key meet theirs in several parts.  Of rows of a key that are equal in ``row`` one is the first.
    """
    part = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(row), F.lit(PARTS))).otherwise(F.lit(0))
    each = F.when(F.col(key).isNull(), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    first = df.groupBy(key).agg(F.min(row).alias("_first")).select(F.col(key).alias("_key"), "_first", F.explode(each.cast("array<long>")).alias("_of"))
    out = df.withColumns({"_part": part.cast("long"), "_place": F.row_number().over(Window.partitionBy(key, row).orderBy(row))})
    out = out.join(first, out[key].eqNullSafe(first["_key"]) & (F.col("_part") == F.col("_of")))
    return out.select(*df.columns, ((F.col(row) == F.col("_first")) & (F.col("_place") == 1)).alias(flag))


def match_markers(df: DataFrame, triples: list[tuple[str, str, str]]) -> DataFrame:
    """(truth, prediction, marker) columns; triples with a missing column are skipped."""
    have = set(df.columns)
    return df.withColumns({m: literal_match(F.col(t), F.col(p)) for t, p, m in triples if t in have and p in have})


def compare_groups(sheet: DataFrame, predictions: DataFrame, case: str, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """The sheet with predictions of the same id, and for each (sheet column, prediction column, name) whether they agree."""
    side = predictions.select(F.col(case).alias("_case"), *(F.col(p).alias(f"_pred_{n}") for _, p, n in pairs))
    out = sheet.join(side, F.col(case) == F.col("_case"), "left")
    return out.withColumns({n: same_key(F.col(s), F.col(f"_pred_{n}")) for s, _, n in pairs}).drop("_case", *(f"_pred_{n}" for _, _, n in pairs))


def last_row(df: DataFrame, row: str, *filled: str) -> DataFrame:
    """The greatest row number with anything in the given columns."""
    some = F.coalesce(*(F.col(c).cast("string") for c in filled)) if filled else F.lit("")
    return df.agg(F.max(F.when(some.isNotNull(), F.col(row))).alias("last_row"))
