"""Record types: a declaration of columns, key and merge rule, from which schema, order and partitions follow.

Every record has three common columns in front: tenant, project and arrival. The arrival decides the partition, a day
in UTC whose RFC 3339 instant is the value of the string column ``partition``; as text it sorts like time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITION = "partition"
ARRIVAL = "received_at"
COMMON = (
    T.StructField("organization_id", T.StringType(), False),
    T.StructField("project_id", T.StringType(), False),
    T.StructField(ARRIVAL, T.TimestampType(), False),
)
TAGS = T.MapType(T.StringType(), T.StringType(), True)
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def day_of(instant: datetime) -> datetime:
    """The start of the instant's day; days before 1970 floor downward as well."""
    return EPOCH + timedelta(days=(instant.astimezone(UTC) - EPOCH) // timedelta(days=1))


def partition_value(instant: datetime) -> str:
    return day_of(instant).strftime("%Y-%m-%dT%H:%M:%SZ")


def partition_start(value: str) -> datetime | None:
    """The instant of a partition's value; None for anything else."""
    try:
        found = datetime.strptime(value, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    except ValueError:
        return None
    return found if day_of(found) == found else None


def partition_column(instant: Column | str = ARRIVAL) -> Column:
    return F.date_format(F.date_trunc("DAY", instant), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@dataclass(frozen=True)
class RecordSpec:
    """A record type. ``version`` names the column whose greatest value wins among rows of one key, if rows merge."""

    table: str
    columns: Sequence[T.StructField]
    key: Sequence[str]
    version: str | None = None
    #: Exact sizes of binary columns and domains of text columns, checked on write.
    sizes: dict[str, int] = field(default_factory=dict)
    domains: dict[str, Sequence[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        seen: set[str] = set()
        for f in [*COMMON, *self.columns]:
            low = f.name.lower()
            if low in seen or low == PARTITION:
                raise ValueError(f"{self.table}: column {f.name} is declared twice or reserved")
            seen.add(low)
        known = {f.name for f in self.schema.fields}
        for name in [*self.key, *([self.version] if self.version else []), *self.sizes, *self.domains]:
            if name not in known:
                raise ValueError(f"{self.table}: no column {name}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*COMMON, *self.columns])

    @property
    def read_schema(self) -> T.StructType:
        """As read from files: nothing is known to be non-null, and the directory gives the partition."""
        return T.StructType([*(T.StructField(f.name, f.dataType) for f in self.schema.fields), T.StructField(PARTITION, T.StringType())])

    @property
    def primary_key(self) -> list[str]:
        return [COMMON[0].name, COMMON[1].name, *self.key]

    def file_order(self) -> list[Column]:
        """Key ascending, then the newest version first, so that what supersedes leads its run."""
        order = [F.col(c).asc_nulls_last() for c in self.primary_key]
        return [*order, F.col(self.version).desc_nulls_last()] if self.version else order

    def checked(self, rows: DataFrame) -> DataFrame:
        """The rows in declared order and types; a row that breaks the declaration fails the job that writes it."""

        def column(f: T.StructField) -> Column:
            c = F.col(f.name).cast(f.dataType)
            if isinstance(f.dataType, T.MapType):
                # Entries by key, so that equal maps are equal bytes; an absent map is an empty one.
                c = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast(f.dataType)))))
            wrong = F.lit(False) if f.nullable else c.isNull()
            if f.name in self.sizes:
                wrong = wrong | F.coalesce(F.octet_length(c) != self.sizes[f.name], F.lit(False))
            if f.name in self.domains:
                wrong = wrong | F.coalesce(~c.isin(list(self.domains[f.name])), F.lit(False))
            if f.nullable and f.name not in self.sizes and f.name not in self.domains or isinstance(f.dataType, T.MapType):
                return c.alias(f.name)
            return F.when(wrong, F.raise_error(F.lit(f"{self.table}.{f.name}: value not allowed")).cast(f.dataType)).otherwise(c).alias(f.name)

        return rows.select(*[column(f) for f in self.schema.fields])


SPANS = RecordSpec(
    table="spans",
    columns=(
        T.StructField("span_id", T.BinaryType(), False),
        T.StructField("trace_id", T.BinaryType(), False),
        T.StructField("parent_span_id", T.BinaryType(), True),
        T.StructField("service", T.StringType(), True),
        T.StructField("name", T.StringType(), False),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("ended_at", T.TimestampType(), True),
        T.StructField("status", T.StringType(), False),
        T.StructField("status_message", T.StringType(), True),
        T.StructField("tags", TAGS, False),
    ),
    key=("trace_id", "span_id"),
    version=ARRIVAL,
    sizes={"span_id": 8, "trace_id": 16, "parent_span_id": 8},
    domains={"status": ("unset", "ok", "error")},
)
