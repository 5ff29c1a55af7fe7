"""Span rows for tests."""

from datetime import UTC, datetime

from spanloom.sources.records import SPANS


def at(day: int, hour: int = 9, minute: int = 0) -> datetime:
    return datetime(2026, 8, day, hour, minute, tzinfo=UTC)


def label(text: str, size: int) -> bytearray:
    return bytearray(text.encode().ljust(size, b"\0"))


def span(span_id="s1", trace_id="t1", received=None, **more):
    received = received or at(17)
    row = {
        "organization_id": "org-a", "project_id": "web", "received_at": received, "span_id": label(span_id, 8), "trace_id": label(trace_id, 16),
        "parent_span_id": None, "service": "billing", "name": "send invoice", "started_at": received, "ended_at": None, "status": "ok",
        "status_message": None, "tags": {},
    }
    row.update(more)
    if isinstance(row["parent_span_id"], str):
        row["parent_span_id"] = label(row["parent_span_id"], 8)
    return row


def frame(spark, *rows):
    names = [f.name for f in SPANS.schema.fields]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SPANS.schema)


def names(df):
    return [bytes(r["span_id"]).rstrip(b"\0").decode() for r in df.select("span_id").collect()]
