"""Picking values out of nested records.

Ranked predictions are ``array<struct<rank, code, name, score, group_1..group_4>>`` inside Spark; maps keyed
top_1, top_2, ... exist at JSON boundaries only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUPS = (1, 2, 3, 4)
RANKED = "array<struct<rank:int,code:bigint,name:string,score:double," + ",".join(f"group_{g}:string" for g in GROUPS) + ">>"


def first(ranked: Column, field: str) -> Column:
    """A field of the best prediction, null when there is none."""
    return F.get(ranked, 0)[field]


def codes(ranked: Column, k: int) -> Column:
    """Codes of the k best, without nulls."""
    return F.filter(F.transform(F.slice(ranked, 1, k), lambda x: x["code"]), lambda c: c.isNotNull())


def groups(ranked: Column, group: int, k: int) -> Column:
    """A group level of the k best; null when nothing is ranked."""
    return F.when(F.size(ranked) > 0, F.transform(F.slice(ranked, 1, k), lambda x: x[f"group_{group}"]))


def hit(truth: Column, values: Column) -> Column:
    """Whether a known truth is among the values; a missing truth never is."""
    return F.coalesce(F.array_contains(values, truth), F.lit(False))


def container(own: Column, has_own: Column, many: Column) -> Column:
    """A record's single container where the key is there, even if null, and else the first of several."""
    return F.when(has_own, own).otherwise(F.get(many, 0))


def with_fallback(ranked: Column, field: str, flat: Column) -> Column:
    """A field of the best prediction; the flat field only if there is no prediction at all."""
    return F.when(F.size(F.coalesce(ranked, F.array().cast(RANKED))) > 0, first(ranked, field)).otherwise(flat)


def rank_map(ranked: Column, prefix: str) -> Column:
    """The map for JSON, with prefixed names; one null entry when nothing is ranked."""

    def entry(x: Column) -> Column:
        named = [x["code"].alias(f"{prefix}_code"), x["name"].alias(f"{prefix}_name"), x["score"].alias(f"{prefix}_score")]
        named += [x[f"group_{g}"].alias(f"{prefix}_group_{g}") for g in GROUPS]
        return F.struct(F.concat(F.lit("top_"), x["rank"].cast("string")), F.struct(*named))

    nothing = F.array(F.struct(F.lit(1).alias("rank"), F.lit(None).cast("bigint").alias("code"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("score"), *(F.lit(None).cast("string").alias(f"group_{g}") for g in GROUPS))).cast(RANKED)
    some = F.when(F.size(F.coalesce(ranked, F.array().cast(RANKED))) > 0, ranked).otherwise(nothing)
    return F.map_from_entries(F.transform(some, entry))


def by_label(containers: Column, label: Column) -> Column:
    """The container with a label."""
    return F.get(F.filter(containers, lambda c: F.trim(c["label"]) == F.trim(label)), 0)


def first_filled(containers: Column, field: str) -> Column:
    """The first value of a field that is not blank."""
    return F.get(F.filter(F.transform(containers, lambda c: F.trim(c[field].cast("string"))), lambda v: v != ""), 0)


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def _scalar(value: Column) -> Column:
    """A variant as text: strings without their quotes, all else as JSON."""
    return F.when(_is(value, "STRING"), value.cast("string")).otherwise(F.to_json(value))


def normalized_containers(json_text: Column) -> Column:
    """JSON of containers as an array of JSON objects: null is empty, anything else than an object becomes a label, null items go.

    Text that is no JSON is a label as it stands.
    """
    value = F.try_parse_json(json_text)
    one = F.array(value)
    items = F.when(F.is_variant_null(value), F.slice(one, 1, 0)).when(_is(value, "ARRAY"), value.cast("array<variant>")).otherwise(one)
    some = F.filter(items, lambda x: x.isNotNull() & ~F.is_variant_null(x))
    objects = F.transform(some, lambda x: F.when(_is(x, "OBJECT"), F.to_json(x)).otherwise(F.to_json(F.struct(_scalar(x).alias("label")))))
    raw = F.array(F.to_json(F.struct(F.trim(json_text).alias("label"))))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.trim(json_text), F.lit("")) == "", none).when(value.isNull(), raw).otherwise(objects)


def picked_container(record_json: Column) -> Column:
    """J10 on a record's JSON: ``container`` where the key is there, null unless it is an object; else the first of ``containers``, as JSON."""
    value = F.try_parse_json(record_json)
    own = F.try_variant_get(value, "$.container", "variant")  # null only where the key is absent
    many = F.try_variant_get(value, "$.containers", "array<variant>")
    first = F.get(many, 0)
    return F.when(own.isNotNull(), F.when(_is(own, "OBJECT"), F.to_json(own))).otherwise(F.when(~F.is_variant_null(first), F.to_json(first)))
