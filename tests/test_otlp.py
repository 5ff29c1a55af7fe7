import gzip
import json
import struct
import threading
import urllib.error
import urllib.request
from datetime import UTC, datetime

import pytest

from spanloom import api, cli
from spanloom.functions import otlp
from spanloom.operators import traces as tr
from spanloom.sources import seed
from spanloom.sources.catalog import Catalog
from spanloom.sources.records import SPANS
from spanloom.sources.store import Store
from spanloom.streaming import receiver
from spanloom.streaming.ingest import Ingest
from spanloom.streaming.landing import Full, Landing
from tests.spans import at, frame, span


def varint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def f(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def fixed(number, n):
    return varint(number << 3 | 1) + struct.pack("<Q", n)


def attr(key, kind=None, value=None):
    any_value = b"" if kind is None else varint(kind << 3 | 1) + struct.pack("<d", value) if kind == 4 else f(kind, value)
    return f(1, key) + f(2, any_value)


def wire_span(trace=b"\xab" * 16, own=b"\xcd" * 8, start=1_000_000, end=2_000_999, extra=b""):
    return f(1, trace) + f(2, own) + f(5, "charge card") + fixed(7, start) + fixed(8, end) + extra


def request(*spans, resource=b""):
    return f(1, (f(1, resource) if resource else b"") + f(2, b"".join(f(2, s) for s in spans)))


def test_a_finished_span():
    extra = f(9, attr("env", 1, "prod")) + f(9, attr("retries", 3, 2)) + f(9, attr("sampled")) + f(15, f(2, "card declined") + f(3, 2))
    (row,) = otlp.decode(request(wire_span(extra=extra)), at(17))
    assert row["tags"] == {"env": "prod", "retries": "2", "sampled": None} and (row["status"], row["status_message"]) == ("error", "card declined")
    assert row["started_at"].microsecond == 1000 and row["ended_at"].microsecond == 2000 and row["received_at"] == at(17) and row["parent_span_id"] is None


def test_the_rest_of_the_mapping():
    resource = f(1, attr("service.name", 1, "checkout")) + f(1, attr("service.name", 1, "second")) + f(1, attr("env", 1, "staging")) + f(1, attr("host", 1, "web-1"))
    rows = otlp.decode(request(wire_span(end=0, extra=f(9, attr("env", 1, "prod")) + f(4, b"\x01" * 8)), wire_span(own=b"\x02" * 8, extra=f(4, b"short")), wire_span(own=b"bad"), resource=resource), at(17))
    assert len(rows) == 2 and [r["service"] for r in rows] == ["checkout"] * 2 and [r["tags"]["env"] for r in rows] == ["prod", "staging"]
    assert rows[0]["ended_at"] is None and rows[0]["parent_span_id"] == b"\x01" * 8 and rows[1]["parent_span_id"] is None and "service.name" not in rows[0]["tags"]
    assert [otlp.double_text(x) for x in (1.0, 1e10, 0.1, -0.0, 1e-7, 1e21, float("nan"), float("-inf"))] == ["1", "10000000000", "0.1", "-0", "0.0000001", "1" + "0" * 21, "NaN", "-inf"]
    assert [otlp.tag_text(v) for v in (f(2, 1), f(2, 0), f(3, -5), f(7, b"\x0a\xff"), f(5, b""), f(6, b""), b"")] == ["true", "false", "-5", "0aff", None, None, None]
    for bad in (b"not protobuf", f(1, f(2, f(2, b"\xff")))[:-1], varint(1 << 3 | 3)):
        with pytest.raises(otlp.Malformed):
            otlp.decode(bad, at(17))


def post(url, body, **headers):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=60) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


@pytest.fixture
def serving():
    running = []

    def start(s):
        threading.Thread(target=s.serve_forever, daemon=True).start()
        running.append(s)
        return f"http://127.0.0.1:{s.server_address[1]}"

    yield start
    for s in running:
        s.shutdown()
        s.server_close()


def test_received_spans_reach_their_day_once(spark, tmp_path, serving):
    store = Store(spark, str(tmp_path / "store"))
    landing = Landing(store.files, str(tmp_path / "landing"), most_waiting=2)
    url = serving(receiver.server(landing, port=0)) + "/v1/traces"
    body = request(wire_span())
    assert post(url, body) == (200, b"") and post(url, gzip.compress(body), **{"Content-Encoding": "gzip"})[0] == 200
    assert post(url, body)[0] == 503 and post(url, b"nonsense")[0] == 400 and post(url, b"nonsense", **{"Content-Encoding": "gzip"})[0] == 400 and post(url + "x", body)[0] == 404
    with pytest.raises(Full):
        landing.send(body, at(17), timeout=0.1)
    ingest = Ingest(store, landing, str(tmp_path / "checkpoint"))
    ingest.start()
    ingest.drain()
    assert store.read(SPANS).count() == 2 and landing.waiting() == 0
    again = Landing(store.files, str(tmp_path / "landing"))
    again.push(request(wire_span(own=b"\x09" * 8)), at(18))
    again.committed = lambda paths: None  # as if it had died before its bodies were gone
    Ingest(store, again, str(tmp_path / "checkpoint")).flush()
    del again.committed
    assert sorted(store.partitions(SPANS))[0] == "2026-08-18T00:00:00Z" and store.read(SPANS).count() == 3 and again.waiting() == 1
    Ingest(store, again, str(tmp_path / "checkpoint")).sweep()
    assert again.waiting() == 0


def test_a_full_landing_folder_has_room_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    landing = Landing(store.files, str(tmp_path / "landing"), most_waiting=64)
    ingest = Ingest(store, landing, str(tmp_path / "checkpoint"), seconds=0.5)
    ingest.start()
    for i in range(130):  # waits whenever 64 bodies wait
        landing.send(request(wire_span(own=struct.pack("<Q", i + 1))), at(17), timeout=90)
    ingest.drain()
    assert store.read(SPANS).select("span_id").distinct().count() == 130 == store.read(SPANS).count() and landing.waiting() == 0


def test_flushes_by_rows_or_by_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    landing = Landing(store.files, str(tmp_path / "landing"), most_rows=50)
    now = datetime.now(UTC)
    assert not landing.due(10, 0)
    landing.push(b"x", now, rows=4)
    assert not landing.due(10, 60) and landing.due(4, 60) and landing.due(10, 0)
    landing.push(b"x", now, rows=46)
    with pytest.raises(Full):
        landing.push(b"x", now, rows=1)
    landing.committed([f"{landing.folder}/{n}" for n in list(landing._names)])
    assert landing.push(b"x", now, rows=1)


def test_a_flush_that_fails_leaves_its_bodies(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    landing = Landing(store.files, str(tmp_path / "landing"))
    landing.push(request(wire_span()), at(17))
    ingest = Ingest(store, landing, str(tmp_path / "checkpoint"))
    with monkeypatch.context() as m:
        m.setattr(store, "write", lambda *a, **k: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivision"):
            ingest.flush()
    assert landing.waiting() == 1
    ingest.flush()
    assert landing.waiting() == 0 and store.read(SPANS).count() == 1


def test_a_repeated_batch_replaces_its_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    landing = Landing(store.files, str(tmp_path / "landing"))
    landing.push(request(wire_span(), wire_span(own=b"\x02" * 8)), at(17))
    ingest = Ingest(store, landing, str(tmp_path / "checkpoint"))
    bodies = spark.read.format("binaryFile").load(landing.folder)
    assert ingest.write_batch(bodies, 7, "q") == ingest.write_batch(bodies, 7, "q") and store.read(SPANS).count() == 2


def test_sql_over_http(spark, tmp_path, serving):
    catalog = Catalog(spark, str(tmp_path))
    catalog.store.write(SPANS, frame(spark, span("s1", tags={"a": None, "b": "x"})))
    url = serving(api.server(catalog, port=0))
    status, body = post(url + "/sql", json.dumps({"sql": "select span_id, started_at, ended_at, tags from spans"}).encode())
    assert status == 200 and json.loads(body)["rows"] == [{"span_id": "7331000000000000", "started_at": "2026-08-17T09:00:00Z", "tags": {"a": None, "b": "x"}}] and json.loads(body)["elapsed_ms"] > 0
    for bad in (b"{}", b"x", json.dumps({"sql": "drop table spans"}).encode(), json.dumps({"sql": "select nothing from spans"}).encode()):
        assert post(url + "/sql", bad)[0] == 400
    assert json.loads(post(url + "/sql", json.dumps({"sql": "select 1 a", "organization_id": "x"}).encode())[1])["rows"] == [{"a": 1}]
    get = lambda path: json.loads(urllib.request.urlopen(url + path, timeout=60).read())["rows"]
    (operation,) = get("/operations?hours=0&search=service:billing%20INV")
    assert (operation["root_name"], operation["traces"]) == ("send invoice", 1) and get("/operations?hours=0&search=nothing") == []
    (found,) = get("/traces?hours=0&service=billing&name=send%20invoice&sort=latest")
    assert found["trace_id"] == "74310000000000000000000000000000" and found["spans"] == 1
    (bar,) = get(f"/trace?id={found['trace_id']}&first={found['first_partition']}&last={found['last_partition']}")
    assert (bar["depth"], bar["name"], bar["ended"]) == (0, "send invoice", False)
    many = json.loads(post(url + "/sql", json.dumps({"sql": "select id from range(12345)"}).encode())[1])["rows"]
    assert [r["id"] for r in many] == list(range(12345)) and json.loads(post(url + "/sql", json.dumps({"sql": "select 1 a where false"}).encode())[1])["rows"] == []
    mine = serving(api.server(catalog, port=0, tenant=lambda headers: {"organization_id": headers["X-Org"]})) + "/sql"
    count = lambda **h: json.loads(post(mine, json.dumps({"sql": "select count(*) n from spans", "organization_id": "org-a"}).encode(), **h)[1])["rows"][0]["n"]
    assert count(**{"X-Org": "org-a"}) == 1 and count(**{"X-Org": "other"}) == 0
    with urllib.request.urlopen(url + "/", timeout=20) as r:
        assert b"<title>" in r.read()
    assert api.instant(datetime(2026, 1, 1, 0, 0, 0, 946800, tzinfo=UTC)) == "2026-01-01T00:00:00.9468Z"


def test_seed_and_command_line(spark, tmp_path):
    until = at(20)
    a, b = (seed.spans(spark, 3, 40, 5, until) for _ in range(2))
    assert a.drop("tags").exceptAll(b.drop("tags")).count() == 0
    assert a.select("trace_id").distinct().count() == 120 and a.select("span_id").distinct().count() == a.count()
    child = a.alias("c").join(a.alias("p"), "trace_id").where("c.parent_span_id = p.span_id")
    assert child.where("c.started_at < p.started_at or c.ended_at > p.ended_at").count() == 0
    assert child.count() == a.where("parent_span_id is not null").count()
    path = str(tmp_path)
    assert cli.main(["--path", path, "seed", "--days", "2", "--traces", "30"], spark) == 0
    store = Store(spark, path)
    before, files = store.read(SPANS).count(), len(store.live_files(SPANS))
    assert cli.main(["--path", path, "compact"], spark) == 0
    assert store.read(SPANS).count() == before and len(store.live_files(SPANS)) < files
    assert tr.operations(tr.traces(store.read(SPANS))).agg({"traces": "sum"}).first()[0] == 60
    args = cli.parser().parse_args(["otlp", "--addr", "0.0.0.0:99"])
    assert args.addr == ("0.0.0.0", 99)
