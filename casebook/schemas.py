"""Versioned schemas of extraction records.

A field's metadata says whether its values are held to the vocabulary (``constrained``) and
whether it is kept from the model (``hidden``).
"""

from __future__ import annotations

from pyspark.sql import types as T

CONSTRAINED, HIDDEN = "constrained", "hidden"


def _field(name: str, kind: T.DataType, *flags: str) -> T.StructField:
    return T.StructField(name, kind, True, dict.fromkeys(flags, True))


_S, _B, _L, _D = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()
CONTAINER = T.StructType([_field("label", _S), _field("specimen", _S), _field("is_lymph_node", _B), _field("anatomic_location", _S), _field("diagnosis", _S)])
SLIM_CONTAINER = T.StructType([_field("label", _S), _field("is_lymph_node", _B), _field("diagnosis", _S, CONSTRAINED)])
BIOMARKER = T.StructType([T.StructField("name", _S, False), _field("value", _S)])

_HEAD = [_field("schema_version", _S), _field("case_id", _L, HIDDEN)]
_PRIMARY = _field("primary_diagnosis", _S, CONSTRAINED)
_FLAGS = [_field(f"has_{x}", _B) for x in ("differential_diagnosis", "prior_malignancy", "concurrent_malignancy")]

#: The fields of each version, in order.
VERSIONS: dict[str, T.StructType] = {
    "v2": T.StructType([*_HEAD, _PRIMARY, _FLAGS[0], _field("differential_diagnoses", T.ArrayType(_S), CONSTRAINED), _field("specimen", _S), _field("is_lymph_node", _B), _field("is_definitive", _B), *_FLAGS[1:], _field("anatomic_location", _S), _field("container", _S), _field("biomarkers", T.ArrayType(BIOMARKER)), _field("confidence", _D)]),
    "v3": T.StructType([*_HEAD, _PRIMARY, _field("is_definitive", _B), _field("containers", T.ArrayType(CONTAINER)), *_FLAGS, _field("confidence", _D)]),
    "v4": T.StructType([*_HEAD, _field("primary_diagnosis", _S)]),
    "v5": T.StructType([*_HEAD, _PRIMARY, _field("is_definitive", _B), _field("containers", T.ArrayType(CONTAINER)), *_FLAGS]),
    "v6": T.StructType([*_HEAD, _PRIMARY, *(_field(f"diagnosis_group_{k}", _S) for k in (1, 2, 3))]),
    "v7": T.StructType([*_HEAD, _PRIMARY, _field("is_definitive", _B), _field("containers", T.ArrayType(SLIM_CONTAINER)), *_FLAGS]),
}
DEFAULT = "v5"
MOST_DIFFERENTIALS = 10


def get(version: str) -> T.StructType:
    if version not in VERSIONS:
        raise ValueError(f"unknown schema version {version!r}; known: {', '.join(VERSIONS)}")
    return VERSIONS[version]


def constrained_paths(schema: T.StructType) -> list[tuple[str, ...]]:
    """Paths of fields held to the vocabulary; an array in a path stands for each of its items."""
    found: list[tuple[str, ...]] = []
    for f in schema.fields:
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if f.metadata.get(CONSTRAINED):
            found.append((f.name,))
        elif isinstance(inner, T.StructType):
            found += [(f.name, *rest) for rest in constrained_paths(inner)]
    return found


_JSON = {T.StringType: "string", T.BooleanType: "boolean", T.LongType: "integer", T.DoubleType: "number"}


def json_schema(schema: T.StructType, title: str = "record", vocabulary: list[str] | None = None, show_hidden: bool = False) -> dict:
    """JSON schema for a constrained decoder.

    Hidden fields go, every field is required though it may be null, nothing else is allowed, and constrained strings are limited
    to the sorted vocabulary, if there is one.
    """

    def of(kind: T.DataType, constrained: bool) -> dict:
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": of(kind.elementType, constrained)}
        if isinstance(kind, T.StructType):
            return json_schema(kind, "item", vocabulary, show_hidden)
        out: dict = {"type": _JSON[type(kind)]}
        if constrained and vocabulary is not None:
            out["enum"] = sorted(vocabulary)
        return out

    shown = [f for f in schema.fields if show_hidden or not f.metadata.get(HIDDEN)]
    props = {}
    for f in shown:
        made = of(f.dataType, bool(f.metadata.get(CONSTRAINED)))
        props[f.name] = {"anyOf": [made, {"type": "null"}]} if f.nullable else made
    return {"title": title, "type": "object", "properties": props, "required": list(props), "additionalProperties": False}
