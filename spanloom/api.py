"""Queries over HTTP, and a page to look at operations, traces and waterfalls from.

``POST /sql`` with ``{"sql": ...}`` answers ``{"rows": [...], "elapsed_ms": x}``; an optional ``organization_id`` and
``project_id`` scope the tables, unless the server has a rule for that, which then decides alone. 400 with the reason
for a query that fails or isn't one. Rows are sent as they are fetched, a partition at a time, so an answer of any size
needs no memory for it; one that fails on the way ends without its last chunk. Ids are hexadecimal, instants RFC 3339,
and null columns are left out.

``GET /operations``, ``/traces`` and ``/trace`` answer what the page shows, with rows in the same form.
"""

from __future__ import annotations

import json
import logging
import math
import time
from collections.abc import Callable, Iterable
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal
from email.message import Message
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qsl, urlsplit

from pyspark.errors import PySparkException
from pyspark.sql import Row

from spanloom.operators import traces as tr
from spanloom.sources.catalog import Catalog, NotAQuery

log = logging.getLogger(__name__)
PAGE = Path(__file__).with_name("page.html")


def instant(value: datetime) -> str:
    """RFC 3339 with no more digits than it needs."""
    text = value.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S") if value.tzinfo else value.strftime("%Y-%m-%dT%H:%M:%S")
    fraction = f".{value.microsecond:06d}".rstrip("0").rstrip(".")
    return text + fraction + ("Z" if value.tzinfo else "")


def plain(value, utc: bool = True):
    """A value as JSON has it."""
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, datetime):
        return instant(value if value.tzinfo else value.replace(tzinfo=UTC) if utc else value)
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, dict):
        return {str(plain(k)): plain(v) for k, v in value.items()}  # a bare tag is a key with null
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def operations(catalog: Catalog, scope: dict, q: dict) -> Iterable[Row]:
    rolled = tr.traces(catalog.recent(_since(q), merged="merged" in q, **scope))
    return tr.ordered(tr.operations(rolled, q.get("search", "")), q.get("sort", "last_seen")).toLocalIterator()


def traces(catalog: Catalog, scope: dict, q: dict) -> Iterable[Row]:
    rolled = tr.traces(catalog.recent(_since(q), merged="merged" in q, **scope))
    return tr.traces_of(rolled, q.get("service"), q.get("name"), q.get("sort", "slowest")).collect()  # fifty at most


def trace(catalog: Catalog, scope: dict, q: dict) -> Iterable[dict]:
    rows = catalog.recent(None, values=(q["first"], q["last"]), merged="merged" in q, **scope)
    return tr.waterfall(tr.spans_of(rows, q["id"], q["first"], q["last"]).collect())


def _since(q: dict) -> datetime | None:
    hours = float(q.get("hours", 24))
    return datetime.now(UTC) - timedelta(hours=hours) if hours > 0 else None


PAGES = {"/operations": operations, "/traces": traces, "/trace": trace}


def server(catalog: Catalog, host: str = "127.0.0.1", port: int = 8080, tenant: Callable[[Message], dict] | None = None) -> ThreadingHTTPServer:
    """``tenant`` gives the scope of a request by its headers (which whoever stands in front has checked); without it a
    request says its own."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self, status: int, body: bytes, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def chunk(self, text: str) -> None:
            data = text.encode()
            if data:
                self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))

        def rows(self, ask: Callable[[], Iterable]) -> None:
            began = time.perf_counter()
            try:
                found = iter(ask())
                first = next(found, None)  # whatever is wrong with the query shows now
            except (ValueError, KeyError, TypeError, NotAQuery, PySparkException) as e:
                return self.answer(400, str(e).split("\n\nJVM", 1)[0].encode(), "text/plain; charset=utf-8")
            except Exception as e:
                log.exception("query failed")
                return self.answer(500, type(e).__name__.encode(), "text/plain")
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            try:
                held = ['{"rows": [' + (json.dumps(plain(first)) if first is not None else "")]
                for r in found:
                    held.append(", " + json.dumps(plain(r)))
                    if len(held) >= 500:
                        self.chunk("".join(held))
                        held = []
                elapsed = round((time.perf_counter() - began) * 1000, 1)
                self.chunk("".join(held) + f'], "elapsed_ms": {elapsed}}}')
                self.wfile.write(b"0\r\n\r\n")
            except Exception:
                log.exception("an answer broke off")
                self.close_connection = True
            return None

        def scope(self, asked: dict) -> dict:
            given = tenant(self.headers) if tenant else asked
            return {k: given.get(k) for k in ("organization_id", "project_id")}

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path in PAGES:
                q = dict(parse_qsl(url.query, keep_blank_values=True))
                return self.rows(lambda: PAGES[url.path](catalog, self.scope(q), q))
            if url.path != "/":
                return self.answer(404, b"", "text/plain")
            return self.answer(200, PAGE.read_bytes(), "text/html; charset=utf-8")

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.path != "/sql":
                return self.answer(404, b"", "text/plain")

            def ask() -> Iterable[Row]:
                asked = json.loads(body)
                return catalog.select(asked["sql"], **self.scope(asked)).toLocalIterator(prefetchPartitions=True)

            return self.rows(ask)

        def log_message(self, format: str, *args) -> None:
            log.debug(format, *args)

    return ThreadingHTTPServer((host, port), Handler)
