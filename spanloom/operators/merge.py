"""The newest version of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.sources.records import PARTITION, RecordSpec


def _tie_breaks(spec: RecordSpec) -> list[Column]:
    """Rows of one version are ordered by all that they hold, so that the same one wins every time."""
    out = []
    for f in spec.schema.fields:
        if f.name in spec.primary_key or f.name == spec.version:
            continue
        c = F.to_json(F.array_sort(F.map_entries(f.name))) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        out.append(c.desc_nulls_last())
    return out


def newest(rows: DataFrame, spec: RecordSpec) -> DataFrame:
    """One row per key and partition: the one of the greatest version, whole, never put together from several.

    A predicate on ``partition`` or the key reaches the scan, since both are in the ranking key; one on the version
    stays above the ranking, where it belongs.
    """
    if not spec.version:
        return rows
    w = Window.partitionBy(*spec.primary_key, PARTITION).orderBy(F.col(spec.version).desc_nulls_last(), *_tie_breaks(spec))
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
