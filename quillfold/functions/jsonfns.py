"""JSON in one canonical form, its hash, and reading with a fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys in alphabetical order and no blanks; null values are kept as null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def hash16(c: Column) -> Column:
    """The first 16 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def parse_or(c: Column, schema: str, fallback: str = "value") -> Column:
    """A JSON text by its schema; what can't be read comes back whole in the text field ``fallback`` of the same shape."""
    got = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    readable = F.try_parse_json(c).isNotNull()
    return F.when(readable, got).otherwise(F.from_json(F.to_json(F.struct(c.alias(fallback))), schema))
