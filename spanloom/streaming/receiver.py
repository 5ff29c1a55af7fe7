"""The receiver of trace exports over HTTP.

``POST /v1/traces`` with a request's bytes, plain or gzipped. 200 with an empty answer once the body is durable, 400
for what isn't a request, 413 for what is too large, 503 when too many bodies wait.
"""

from __future__ import annotations

import gzip
import logging
import zlib
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from spanloom.functions import otlp
from spanloom.streaming.landing import Full, Landing

log = logging.getLogger(__name__)

MOST_BYTES = 64 << 20


def plain(body: bytes, encoding: str | None) -> bytes:
    """The body, uncompressed if its encoding says gzip."""
    if (encoding or "").strip().lower() != "gzip":
        return body
    try:
        return gzip.decompress(body)
    except (OSError, EOFError, zlib.error) as e:
        raise otlp.Malformed("the body isn't gzip") from e


def server(landing: Landing, host: str = "127.0.0.1", port: int = 4318) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self, status: int, body: bytes = b"", kind: str = "application/x-protobuf") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                self.close_connection = True
                return self.answer(413)
            body = self.rfile.read(size)
            if self.path != "/v1/traces":
                return self.answer(404)
            arrival = datetime.now(UTC)
            try:
                body = plain(body, self.headers.get("Content-Encoding"))
                rows = len(otlp.decode(body, arrival))  # a body that can't be decoded must never reach the stream
                if rows:
                    landing.push(body, arrival, rows)
            except otlp.Malformed as e:
                return self.answer(400, str(e).encode(), "text/plain")
            except Full:
                return self.answer(503)
            return self.answer(200)

        def log_message(self, format: str, *args) -> None:
            log.debug(format, *args)

    return ThreadingHTTPServer((host, port), Handler)
