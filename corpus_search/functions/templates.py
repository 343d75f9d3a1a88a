"""Prompt templates: checked and split once on the driver, filled by one concatenation per row.

Inserted text is never expanded again, so a document holding "{chunk}" stays as it is.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_template(template: str, fields: set[str]) -> list[tuple[str, str | None]]:
    """Pieces of (literal, field after it). Unknown, missing or malformed placeholders fail here,
    before a job starts."""
    parsed = list(Formatter().parse(template))
    if any(spec or conversion for _, _, spec, conversion in parsed):
        raise ValueError("placeholders take no conversion and no format")
    pieces = [(literal, field) for literal, field, _, _ in parsed]
    used = {field for _, field in pieces if field is not None}
    if unknown := used - fields:
        raise ValueError(f"unknown placeholders: {sorted(unknown)}")
    if missing := fields - used:
        raise ValueError(f"missing placeholders: {sorted(missing)}")
    return pieces


def fill(template: str, **values: Column) -> Column:
    parts: list[Column] = []
    for literal, field in split_template(template, set(values)):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field])
    return F.concat(*parts)
