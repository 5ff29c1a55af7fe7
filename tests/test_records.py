from datetime import UTC, datetime

import pytest
from pyspark.sql import types as T

from spanloom.sources.records import SPANS, RecordSpec, partition_column, partition_start, partition_value
from tests.spans import at, frame, span


def test_days_floor_and_parse():
    assert partition_value(datetime(2026, 8, 17, 23, 59, 59, 999999, tzinfo=UTC)) == "2026-08-17T00:00:00Z"
    assert partition_value(datetime(1969, 12, 31, 23, tzinfo=UTC)) == "1969-12-31T00:00:00Z"
    assert partition_start("2026-08-17T00:00:00Z") == datetime(2026, 8, 17, tzinfo=UTC)
    assert partition_start("2026-08-17T01:00:00Z") is None and partition_start("_tmp") is None


def test_a_column_is_declared_once():
    for name in ("project_id", "Project_ID", "partition"):
        with pytest.raises(ValueError):
            RecordSpec("x", [T.StructField(name, T.StringType())], [])
    with pytest.raises(ValueError):
        RecordSpec("x", [T.StructField("a", T.StringType())], ["b"])


def test_schema_and_key():
    assert [f.name for f in SPANS.schema.fields][:4] == ["organization_id", "project_id", "received_at", "span_id"]
    assert SPANS.primary_key == ["organization_id", "project_id", "trace_id", "span_id"]
    assert SPANS.read_schema.fieldNames()[-1] == "partition"


def test_partition_column_agrees(spark):
    moments = [at(17), at(18, 0), at(18, 23, 59), datetime(1969, 12, 31, 1, tzinfo=UTC)]
    got = spark.createDataFrame([(m,) for m in moments], "received_at timestamp").select(partition_column()).collect()
    assert [r[0] for r in got] == [partition_value(m) for m in moments]


def test_rows_are_checked(spark):
    good = SPANS.checked(frame(spark, span(tags={"b": "1", "a": None}))).collect()[0]
    assert list(good["tags"].items()) == [("a", None), ("b", "1")]
    for bad in (span(status="broken"), span(span_id="s1", trace_id="t", parent_span_id=bytearray(b"short"))):
        with pytest.raises(Exception, match="value not allowed"):
            SPANS.checked(frame(spark, bad)).collect()
