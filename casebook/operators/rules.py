"""What prompts ask of a model and plain expressions can do: definitive wording, container labels, staged matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wordings of an open diagnosis, ours; a caller may give others.
UNCERTAIN = (
    r"definitive (?:diagnosis|classification) (?:cannot|could not|can not)",
    r"(?:cannot|can not|could not) (?:be )?(?:exclude|rule[d]? out|establish|ma[dk]e)",
    r"(?:additional|more|further) (?:tissue|material|sampling)",
    r"(?:excision|excisional biopsy|re-?biopsy) (?:is |are )?(?:recommended|suggested|advised)",
    r"non-?diagnostic|insufficient for (?:a )?diagnosis|suspicious for|suggestive of",
)


def definitive(text: Column, uncertain=UNCERTAIN) -> Column:
    """Whether a report has no wording of an open diagnosis; null for null text."""
    return ~text.rlike("(?i)(?:" + "|".join(uncertain) + ")")


def container_labels(text: Column) -> Column:
    """Labels of containers in order: letters or numbers that start a line, and of (CODE; DATE) the code; each once."""
    at_start = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:Part |Specimen )?([A-Z](?:\s?&\s?[A-Z])*|\d{1,2}(?:\s?&\s?\d{1,2})*)[.:)]\s"), F.lit(1))
    coded = F.regexp_extract_all(text, F.lit(r"\(([A-Z]{2}\d{2}-\d+);\s*\d{1,2}/\d{1,2}/\d{4}\)"), F.lit(1))
    return F.array_distinct(F.concat(at_start, coded))


def flag(text: Column, pattern: str, silent_is_null: bool) -> Column:
    """A flag that is true where a pattern occurs; elsewhere null in v2, false in later versions."""
    return F.when(text.rlike(pattern), True).otherwise(F.lit(None).cast("boolean") if silent_is_null else F.lit(False))


def staged(*matches: Column) -> Column:
    """The first match that is there: whole structs, so that code and name are of one dictionary row."""
    return F.coalesce(*matches)


def by_priority(containers: Column, priorities: list) -> Column:
    """The first container that fits the earliest of several predicates."""
    return F.coalesce(*(F.get(F.filter(containers, p), 0) for p in priorities))
