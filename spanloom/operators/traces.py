"""Traces and operations: the questions that a trace view asks, as DataFrame builders.

All of them are plain aggregations, so they run partial-first, and bounds on the arrival reach the scan.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.plans.pruning import between_received

#: Fixed value: traces listed for an operation.
TRACES_LISTED = 50


def traces(spans: DataFrame, since: datetime | None = None) -> DataFrame:
    """Spans rolled up by trace. Root columns come from spans without a parent; seconds are null while none ended."""
    root = F.col("parent_span_id").isNull()
    seconds = lambda c: F.unix_micros(c) / F.lit(1e6)
    return (
        between_received(spans, low=since)
        .groupBy("trace_id")
        .agg(
            F.min(F.when(root, F.col("service"))).alias("root_service"),
            F.min(F.when(root, F.col("name"))).alias("root_name"),
            F.min("started_at").alias("started_at"),
            F.min("partition").alias("first_partition"),
            F.max("partition").alias("last_partition"),
            F.count("*").alias("spans"),
            (seconds(F.max("ended_at")) - seconds(F.min("started_at"))).alias("seconds"),
        )
    )


def search(text: str) -> Column:
    """``service:x`` pins the root service; the rest of the text is looked for in the root's name, without case."""
    token = re.search(r"service:(\S+)", text, re.I)
    rest = re.sub(r"service:\S+", "", text, flags=re.I).strip()
    found = F.lit(True)
    if token:
        found = found & (F.col("root_service") == token[1])
    if rest:
        found = found & F.col("root_name").ilike(f"%{rest}%")
    return found


def operations(rolled: DataFrame, text: str = "", exact: bool = True) -> DataFrame:
    """Traces rolled up by root service and name, with mean and 95th percentile in milliseconds.

    The exact percentile keeps one count per distinct duration; over very many of them take the approximate one.
    """
    p95 = F.percentile("seconds", F.lit(0.95)) if exact else F.percentile_approx("seconds", 0.95, 10_000)
    return (
        rolled.where(search(text))
        .groupBy("root_service", "root_name")
        .agg(F.count("*").alias("traces"), (F.avg("seconds") * 1000).alias("avg_ms"), (p95 * 1000).alias("p95_ms"), F.max("started_at").alias("last_seen"))
    )


#: Columns by which operations may be put in order.
SORTS = ("last_seen", "root_name", "traces", "avg_ms", "p95_ms")


def table_order(by: str = "last_seen") -> list[Column]:
    """By a column, the latest first among equals, then by name."""
    if by not in SORTS:
        raise ValueError(f"operations aren't ordered by {by}")
    first = F.col("root_name").asc_nulls_first() if by == "root_name" else F.col(by).desc_nulls_last()
    return [first, F.col("last_seen").desc_nulls_last(), F.col("root_service").asc_nulls_first(), F.col("root_name").asc_nulls_first()]


def ordered(found: DataFrame, by: str = "last_seen") -> DataFrame:
    """Operations in table order."""
    return found.orderBy(*table_order(by))


def traces_of(rolled: DataFrame, service: str | None, name: str | None, sort: str = "slowest", limit: int = TRACES_LISTED) -> DataFrame:
    """The slowest or latest traces of one operation; a missing root is asked for with None."""
    by = {"slowest": "seconds", "latest": "started_at"}[sort]
    same = F.col("root_service").eqNullSafe(F.lit(service)) & F.col("root_name").eqNullSafe(F.lit(name))
    columns = ["trace_id", "started_at", "spans", "seconds", "first_partition", "last_partition"]
    return rolled.where(same).select(*columns).orderBy(F.col(by).desc_nulls_last(), F.col("started_at").desc_nulls_last(), "trace_id").limit(limit)


def spans_of(spans: DataFrame, trace_id: bytes | str, first_partition: str, last_partition: str) -> DataFrame:
    """The spans of one trace in the order in which they started; only its own partitions are opened."""
    wanted = bytes.fromhex(trace_id) if isinstance(trace_id, str) else bytes(trace_id)
    columns = ["span_id", "parent_span_id", "service", "name", "status", "status_message", "started_at", "ended_at"]
    return spans.where((F.col("trace_id") == F.lit(bytearray(wanted))) & F.col("partition").between(first_partition, last_partition)).select(*columns).orderBy("started_at", "span_id")


def waterfall(rows: list) -> list[dict]:
    """The spans of one trace, as ``spans_of`` collects them, as a tree read from the top.

    A span whose parent is missing is a root, and so is the first of a cycle, so every span appears once; one that
    hasn't ended has no width. Offsets and widths are shares of the trace's extent.
    """
    by_id = {bytes(r["span_id"]): r for r in rows}
    children: dict[bytes | None, list] = {}
    for r in rows:
        parent = bytes(r["parent_span_id"]) if r["parent_span_id"] is not None else None
        children.setdefault(parent if parent in by_id else None, []).append(r)
    if not rows:
        return []
    low = min(r["started_at"] for r in rows)
    high = max([r["ended_at"] for r in rows if r["ended_at"] is not None] + [max(r["started_at"] for r in rows)])
    extent = (high - low).total_seconds() or 1e-6
    out: list[dict] = []
    seen: set[bytes] = set()

    def walk(first) -> None:
        todo = [(first, 0)]
        while todo:
            r, depth = todo.pop()
            key = bytes(r["span_id"])
            if key in seen:
                continue
            seen.add(key)
            end = r["ended_at"] if r["ended_at"] is not None else r["started_at"]
            out.append({"span_id": key.hex(), "depth": depth, "service": r["service"], "name": r["name"], "status": r["status"], "offset": (r["started_at"] - low).total_seconds() / extent, "width": max(0.0, (end - r["started_at"]).total_seconds()) / extent, "ended": r["ended_at"] is not None})
            todo += [(c, depth + 1) for c in reversed(children.get(key, []))]

    for r in [*children.get(None, []), *rows]:
        walk(r)
    return out
