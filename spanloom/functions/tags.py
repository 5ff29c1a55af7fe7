"""Tags: a map from key to text, where a bare tag is a key whose value is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(tags: Column | str, key: str) -> Column:
    """The tag's value; null for a bare tag and for none at all."""
    return F.try_element_at(F.col(tags) if isinstance(tags, str) else tags, F.lit(key))


def present(tags: Column | str, key: str) -> Column:
    """Whether there is such a tag, bare ones included."""
    return F.map_contains_key(tags, key)


def equals(tags: Column | str, key: str, wanted: str) -> Column:
    return F.coalesce(value(tags, key) == wanted, F.lit(False))


def bare(tags: Column | str, key: str) -> Column:
    return present(tags, key) & value(tags, key).isNull()


def hex_id(column: Column | str) -> Column:
    """An id as people write it."""
    return F.lower(F.hex(column))
