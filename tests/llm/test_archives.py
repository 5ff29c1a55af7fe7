import base64
import hashlib
import io

import pytest

from spanloom.llm import warc
from spanloom.llm.common import new_dir


def test_arc_of_both_versions_reads_back():
    for version in (1, 2):
        content = warc.http_message(b"<p>x</p>\n", 5)
        head = {"URL": "http://e.org/a%20b", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "Content-type": "text/html", "Result-code": "200", "Filename": "f", "Archive-length": str(len(content))}
        raw = warc.arc_head(version, "f.arc", "20010203040506") + warc.arc_line(version, head) + content + b"\n"
        (first, info), (got, body) = warc.read_arc(io.BytesIO(raw))
        assert first["URL"] == "filedesc://f.arc" and info.startswith(str(version).encode())
        assert got["URL"] == "http://e.org/a%20b" and body == content and set(got) == set(warc.FIELDS[version])
        for bad in (raw[:-8], raw.replace(b" text/html ", b" text/html extra "), b"http://x 1 2 3 4\n"):
            with pytest.raises(ValueError):
                list(warc.read_arc(io.BytesIO(bad)))


def test_warc_records():
    head = {"URL": "dns:e.org", "IP-address": "1.2.3.4", "Archive-date": "2001", "Content-type": "text/dns", "Archive-length": "3"}
    raw = warc.warc_record("resource", "a/f.arc", 4, head, b"abc")
    ((fields, block),) = warc.read_warc(io.BytesIO(raw))
    assert block == b"abc" and fields["warc-date"] == "2001-01-01T00:00:00Z" and fields["warc-record-id"] == warc.record_id("b/f.arc", 4) and fields["warc-ip-address"] == "1.2.3.4"
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_warc(io.BytesIO(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))))


def test_a_very_long_url(spark):
    rows = spark.createDataFrame([(1, "http://e.org/" + "a" * 3_000_000, "x"), (2, "http://e.org/", "x")], "page_id long, url string, html string")
    found = {r.key: r for r in warc.records(warc.convert(warc.write_arc(rows, new_dir(spark, "arc")), new_dir(spark, "warc"))).collect()}
    assert len(found[1].url) == 3_000_013 and (found[1].record_type, found[1].refers_to, found[2].record_type) == ("revisit", 2, "response")


def test_a_revisit_has_the_size_that_was_measured():
    head = {"URL": "http://e.org/", "IP-address": "-", "Archive-date": "20010203040506", "Content-type": "text/html", "Archive-length": "9"}
    content = b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\nabc"
    ((fields, block),) = warc.read_warc(io.BytesIO(warc.warc_record("revisit", "f.arc", 1, head, content, ("g.arc", 2, "http://e.org/", "2001", 5))))
    assert fields["warc-payload-length"] == "3" and block.endswith(b"\r\n\r\n") and fields["warc-refers-to-key"] == "5"


def pages(spark):
    rows = [(i, f"http://e.org/{i}", f"<p>{i % 3}</p>", "x") for i in range(9)] + [(20, None, None, "x"), (21, "http://e.org/a b", "", "x"), (22, "u", "ü€", "x"), (None, "u", "<p>0</p>", "x"), (8, "again", "<p>2</p>", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("least", [0, 5])
def test_conversion(spark, least):
    given = pages(spark).repartition(3)
    found = warc.records(warc.convert(warc.write_arc(given, new_dir(spark, "arc")), new_dir(spark, "warc"), min_bytes=least)).collect()
    assert len(found) == 14
    body = {r.page_id: (r.html or "").encode() for r in given.collect() if r.page_id is not None}
    for r in found:
        if r.key is not None:
            assert r.payload_bytes == len(body[r.key]) and r.payload_digest == base64.b32encode(hashlib.sha1(body[r.key]).digest()).decode()
    kinds = {}
    for r in found:
        kinds.setdefault(r.key, []).append((r.record_type, r.refers_to))
    assert kinds[6] == kinds[7] == [("response", None)] and kinds[0] == [("revisit", 6)] and sorted(kinds[8]) == [("response", None), ("revisit", 8)] and kinds[None] == [("revisit", 6)]
    assert kinds[20] == ([("revisit", 21)] if least == 0 else [("response", None)]) and kinds[22] == [("response", None)]
    ids = {r.record_id: r for r in found}
    assert len(ids) == 14 and all(ids[r.refers_to_id].record_type == "response" for r in found if r.refers_to_id)


def test_no_pages(spark):
    arcs = warc.write_arc(pages(spark).where("false"), new_dir(spark, "arc"))
    assert warc.records(warc.convert(arcs, new_dir(spark, "warc"))).count() == 0
