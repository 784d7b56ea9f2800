"""Text scalars.  Unicode compatibility forms need one vectorised Python function; all else is built in."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _compat(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text)


def _repaired(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return text.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return text


def _each(change) -> Callable[[Column], Column]:
    """A vectorised function of texts."""

    def of(text: Column) -> Column:
        @F.pandas_udf("string")
        def run(part: pd.Series) -> pd.Series:
            return part.map(change)

        return run(text)

    return of


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark lacks."""
    return _each(_compat)(text)


def collapse(text: Column) -> Column:
    """Runs of white space (of Unicode) as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def standardize(text: Column) -> Column:
    """Lower case, text decoded twice repaired, compatibility forms, controls and odd spaces as spaces, spaces collapsed."""
    clean = _each(lambda t: _compat(_repaired(t)))(F.lower(text))
    clean = F.regexp_replace(F.regexp_replace(clean, " ", " "), "Â", "")
    return collapse(F.regexp_replace(clean, r"[\x00-\x1F\x7F-\x9F]", " "))


def alphanumeric(text: Column, compatibility: bool = True) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one space, trimmed."""
    base = nfkc(text) if compatibility else text
    return F.trim(F.regexp_replace(F.lower(base), "[^a-z0-9]+", " "))


def match_key(value: Column) -> Column:
    """Trimmed text with its case folded, null where blank; booleans and numbers by their text.

    Lower case of upper case makes one of letters that differ in case only, and spells out sharp s and ligatures; the final sigma is the other one.
    """
    trimmed = F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.nullif(F.lower(F.translate(F.upper(trimmed), "Σ", "σ")), F.lit(""))


def same_key(a: Column, b: Column) -> Column:
    """T4: equality of match keys; a null on either side is false."""
    return F.coalesce(match_key(a) == match_key(b), F.lit(False))


def case_id(value: Column) -> Column:
    """T5: an id as text, digits and integral numbers canonically, blank as null."""
    text = F.trim(value.cast("string"))
    whole = F.regexp_extract(text, r"^(\d+)(?:\.0+)?$", 1)
    return F.when(whole != "", F.coalesce(F.regexp_replace(whole, r"^0+(?=\d)", ""), text)).when(text != "", text)


def truth(value: Column) -> Column:
    """Null is false, numbers by being non-zero, the words true/1/yes and false/0/no; other text is an error."""
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")
    return (
        F.when(text.isNull() | text.isin("nan", ""), False)
        .when(text.isin("true", "yes"), True)
        .when(text.isin("false", "no"), False)
        .when(number.isNotNull(), number != 0)
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))
    )


def cell(value: Column, kind: str) -> Column:
    """Nested values as JSON text for flat sinks."""
    return F.to_json(value) if kind.startswith(("struct", "array", "map")) else value


def slug(*parts: str | None) -> str:
    """A column name out of display names."""
    made = (re.sub(r"[ /\\]", "_", p.strip().lower()) for p in parts if p)
    return "_".join(p for p in made if p)


def slugged(*parts: Column) -> Column:
    """T8 over rows: names out of the display names that a table holds; null and blank parts go."""
    made = (F.regexp_replace(F.lower(F.trim(p)), r"[ /\\]", "_") for p in parts)
    return F.concat_ws("_", *(F.nullif(m, F.lit("")) for m in made))


def header(columns: list[str], name: str) -> str | None:
    """The column that a display name means, without regard to case and outer spaces."""
    return next((c for c in columns if c.strip().casefold() == name.strip().casefold()), None)


def run_name(path: Column) -> Column:
    """The folder that a file lies in."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def fill_template(template: str, text: Column, placeholder: str = "{input_text}") -> Column:
    """Every occurrence of the placeholder, which must be there, as the text."""
    if placeholder not in template:
        raise ValueError(f"the template lacks {placeholder}")
    return F.replace(F.lit(template), F.lit(placeholder), F.coalesce(text, F.lit("")))


def vocabulary_suffix(prompt: Column, terms: list[str]) -> Column:
    """The prompt, then the allowed terms in order."""
    listed = "\n".join(f"- {t}" for t in sorted(set(terms)))
    return F.concat(prompt, F.lit(f"\n\nAllowed diagnosis terms:\n{listed}"))


def json_only(prompt: Column, template: str | None = None) -> Column:
    """The prompt with a demand for JSON alone, in a chat template with {prompt} if one is given."""
    guarded = F.concat(prompt, F.lit("\n\nAnswer with one JSON object and nothing else."))
    return fill_template(template, guarded, "{prompt}") if template else guarded
