"""Ingest: a stream from the landing folder into day partitions.

A flush runs once enough rows wait or one has waited long enough. It is a run of the stream over what is there: its
batches decode their bodies on the executors and write one sorted file for each day. File names follow from the query,
the batch and the day, so a batch that runs again after a failure replaces its own files. When the run has ended, its
batches are committed and their bodies go at once, so that a full landing folder has room again; what a crash leaves
behind is swept by the stream's own log. A flush that fails leaves its bodies, and senders wait.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanloom.functions import otlp
from spanloom.sources.records import SPANS, partition_start
from spanloom.sources.store import SUFFIX, Store, stable_id
from spanloom.streaming.landing import Landing, arrival_of

log = logging.getLogger(__name__)

#: How long a row waits at most, the rows that are flushed at once, and how often that is looked at.
FLUSH_SECONDS = 10
FLUSH_ROWS = 10_000
LOOK_SECONDS = 1
#: Bodies of a batch.
BODIES_AT_ONCE = 4096
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def decoded(bodies: DataFrame) -> DataFrame:
    """Span rows of (path, content) rows; the path's name has the arrival."""
    names = [f.name for f in SPANS.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [row for path, content in zip(b["path"], b["content"], strict=True) for row in otlp.decode(bytes(content), arrival_of(path))]
            out = pd.DataFrame(rows, columns=names)
            for f in SPANS.schema.fields:
                if isinstance(f.dataType, T.TimestampType):
                    out[f.name] = pd.to_datetime(out[f.name], utc=True)
            yield out

    return bodies.select("path", "content").mapInPandas(run, T.StructType([T.StructField(f.name, f.dataType) for f in SPANS.schema.fields]))


class Ingest:
    def __init__(self, store: Store, landing: Landing, checkpoint: str, rows: int = FLUSH_ROWS, seconds: float = FLUSH_SECONDS):
        self.store, self.landing, self.checkpoint, self.rows, self.seconds = store, landing, checkpoint, rows, seconds
        self._taken: list[str] = []
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def write_batch(self, bodies: DataFrame, batch: int, query: str) -> list[str]:
        """Writes one batch under names that it will have again if it is repeated."""

        def name(value: str, ordinal: int) -> str:
            day = partition_start(value)
            millis = int(day.timestamp() * 1000) + batch % 86_400_000 if day else batch
            return stable_id(max(0, millis), query, batch, value, ordinal) + SUFFIX

        return self.store.write(SPANS, decoded(bodies), name, files_per_partition=1)

    def flush(self) -> int:
        """Writes all bodies that wait and deletes them; how many they were."""
        spark, self._taken = self.store.spark, []

        def batch(bodies: DataFrame, number: int) -> None:
            self.write_batch(bodies, number, self.checkpoint)
            self._taken += [r["path"] for r in bodies.select("path").collect()]

        source = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.otlp").option("maxFilesPerTrigger", BODIES_AT_ONCE)
        writer = source.load(self.landing.folder).writeStream.option("checkpointLocation", self.checkpoint).foreachBatch(batch)
        writer.trigger(availableNow=True).start().awaitTermination()
        self.landing.committed(self._taken)
        return len(self._taken)

    def sweep(self) -> None:
        """Deletes bodies of committed batches that an earlier run left; the stream's own log says which."""
        commits = [int(f.name) for f in self.store.files.list(f"{self.checkpoint}/commits") if f.name.isdigit()]
        logs = [f.path for f in self.store.files.list(f"{self.checkpoint}/sources/0") if not f.name.startswith(".")]
        if not commits or not logs:
            return
        entries = self.store.spark.read.schema("path string, batchId long").json(logs)
        self.landing.committed([r["path"] for r in entries.where(f"path is not null and batchId <= {max(commits)}").select("path").distinct().toLocalIterator()])

    def _run(self) -> None:
        while not self._stop.wait(LOOK_SECONDS):
            try:
                if self.landing.due(self.rows, self.seconds):
                    self.flush()
            except Exception:
                log.exception("flush failed; its bodies stay and are tried again")

    def start(self) -> None:
        """Flushes in the background from now on."""
        self.sweep()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def drain(self) -> None:
        """Takes no more bodies, writes those that wait, and stops."""
        self.landing.close()
        self._stop.set()
        if self._thread:
            self._thread.join()
        self.flush()
