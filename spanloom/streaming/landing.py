"""The landing folder: bodies wait here, durably, between the receiver and the stream that decodes them.

The folder lies on the file system that the store is on, so that executors read what a receiver wrote. A body's file
name begins with its arrival in microseconds, so a replay puts its rows where the first try did, and has the number of
its rows. A body is acknowledged once its file has its final name. What waits is bounded in rows and in bodies; only
bodies that no batch has committed yet count.
"""

from __future__ import annotations

import threading
import time
import uuid
from datetime import UTC, datetime, timedelta

from spanloom.sources.records import EPOCH
from spanloom.sources.store import Files

#: Fixed value: rows that may wait.
MOST_ROWS = 100_000
#: Bodies that may wait.
MOST_WAITING = 4096
SUFFIX = ".otlp"


class Full(Exception):
    """No room for another body; the sender should try again later."""


def _fields(name: str) -> list[str]:
    return name.rsplit("/", 1)[-1].split("-")


def arrival_of(name: str) -> datetime:
    return EPOCH + timedelta(microseconds=int(_fields(name)[0]))


def rows_of(name: str) -> int:
    return int(_fields(name)[1])


class Landing:
    def __init__(self, files: Files, folder: str, most_waiting: int = MOST_WAITING, most_rows: int = MOST_ROWS):
        self.files, self.folder, self.most_waiting, self.most_rows, self.closed = files, folder.rstrip("/"), most_waiting, most_rows, False
        self._lock = threading.Lock()
        files.make(self.folder)
        self._names = self._listed()

    def _listed(self) -> set[str]:
        return {f.name for f in self.files.list(self.folder) if f.name.endswith(SUFFIX)}

    def _full(self) -> bool:
        return len(self._names) >= self.most_waiting or sum(map(rows_of, self._names)) >= self.most_rows

    def waiting(self) -> int:
        return len(self._listed())

    def due(self, rows: int, seconds: float) -> bool:
        """Whether so many rows wait, or one has waited so long."""
        with self._lock:
            self._names = self._listed()  # receivers may be many
            if not self._names:
                return False
            oldest = min(map(arrival_of, self._names))
            return sum(map(rows_of, self._names)) >= rows or (datetime.now(UTC) - oldest).total_seconds() >= seconds

    def push(self, body: bytes, arrival: datetime, rows: int = 1) -> str:
        """Takes a body or raises ``Full`` at once."""
        micros = (arrival - EPOCH) // timedelta(microseconds=1)
        name = f"{micros:020d}-{rows}-{uuid.uuid4().hex}{SUFFIX}"
        with self._lock:
            if not self.closed and self._full():
                self._names = self._listed()  # others may have taken some away
            if self.closed or self._full():
                raise Full
            self._names.add(name)
        final = f"{self.folder}/{name}"
        try:
            self.files.write(final + ".part", body)
            self.files.rename(final + ".part", final)
        except BaseException:
            with self._lock:
                self._names.discard(name)
            raise
        return final

    def send(self, body: bytes, arrival: datetime, rows: int = 1, timeout: float | None = None) -> str:
        """Takes a body, waiting for room."""
        until = None if timeout is None else time.monotonic() + timeout
        while True:
            try:
                return self.push(body, arrival, rows)
            except Full:
                if self.closed or until is not None and time.monotonic() > until:
                    raise
                time.sleep(0.05)

    def committed(self, paths: list[str]) -> None:
        """Deletes bodies whose rows are in the store."""
        for path in paths:
            self.files.delete(path)
        with self._lock:
            self._names.difference_update(p.rsplit("/", 1)[-1] for p in paths)

    def close(self) -> None:
        self.closed = True
