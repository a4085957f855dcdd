"""Identifier columns: UUID spellings and blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = r"^(?:urn:uuid:)?\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?$"


def stripped(c: Column | str) -> Column:
    """Without surrounding white space of any script; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only values."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def canonical_uuid(c: Column) -> Column:
    """32 lower-case hex digits of a UUID in any usual spelling (case, braces, URN, dashes left out, surrounding blanks).

    Null for null and for whatever is no UUID.
    """
    plain = F.lower(stripped(c))
    return F.when(plain.rlike(_UUID), F.regexp_replace(plain, _UUID, "$1$2$3$4$5"))
