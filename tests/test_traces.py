from datetime import timedelta

import pytest

from spanloom.operators import traces as tr
from spanloom.sources.records import SPANS
from spanloom.sources.store import Store
from tests.spans import at, frame, label, span


@pytest.fixture(scope="module")
def spans(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("traces")))
    rows = []
    for i in range(60):
        start = at(17, 9) + timedelta(seconds=i)
        rows += [span("root", f"t{i}", start, name="GET /cart" if i % 2 else "POST /pay", started_at=start, ended_at=start + timedelta(milliseconds=100 + i)), span("kid", f"t{i}", start, parent_span_id="root", service="db", started_at=start, ended_at=start + timedelta(milliseconds=10))]
    rows += [span("lost", "orphan", parent_span_id="gone"), span("open", "open", at(18))]
    store.write(SPANS, frame(spark, *rows))
    return store.read(SPANS)


def test_rollups(spans):
    rolled = tr.traces(spans)
    assert rolled.count() == 62
    one = rolled.where(rolled.trace_id == label("t3", 16)).first()
    assert (one.root_service, one.root_name, one.spans, round(one.seconds, 3)) == ("billing", "GET /cart", 2, 0.103)
    ops = {r.root_name: r for r in tr.operations(rolled).collect()}
    assert ops["GET /cart"].traces == 30 and round(ops["GET /cart"].avg_ms) == 130 and round(ops["GET /cart"].p95_ms, 1) == 156.1
    assert None in ops
    assert [r.root_name for r in tr.operations(rolled, "service:billing CART").collect()] == ["GET /cart"]
    assert tr.operations(rolled, "service:o'neil").count() == 0
    assert tr.traces(spans, since=at(18)).count() == 1


def test_listing(spans):
    rolled = tr.traces(spans)
    listed = tr.traces_of(rolled, "billing", "GET /cart", limit=5).collect()
    assert [round(r.seconds * 1000) for r in listed] == [159, 157, 155, 153, 151]
    assert tr.traces_of(rolled, None, None).count() == 1
    assert tr.ordered(tr.operations(rolled), "traces").first().traces == 30
    assert tr.ordered(tr.operations(rolled), "root_name").first().root_name is None
    found = tr.spans_of(spans, label("t3", 16), listed[0].first_partition, listed[0].last_partition)
    assert "trace_id" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 2


def test_waterfall(spans):
    rows = tr.spans_of(spans, bytes(label("t3", 16)).hex(), "2026-08-17T00:00:00Z", "2026-08-17T00:00:00Z").collect()
    drawn = tr.waterfall(rows)
    assert [(d["depth"], d["service"]) for d in drawn] == [(0, "billing"), (1, "db")] and drawn[0]["width"] == 1.0
    assert tr.waterfall([]) == []
    loop = [dict(span("a", parent_span_id="b")), dict(span("b", parent_span_id="a")), dict(span("c", parent_span_id="gone"))]
    assert sorted(d["depth"] for d in tr.waterfall(loop)) == [0, 0, 1]
