"""Compaction: small files of a partition become one sorted file that names them.

The planner takes the smallest files first, up to six and up to the target size. A closed partition merges whatever
it has; in the newest one, which still receives files, a batch waits until it is full, and starts over at a file that
is much larger than the batch's first, so that crumbs don't rewrite large files again and again.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from spanloom.operators.merge import newest
from spanloom.sources.records import RecordSpec
from spanloom.sources.store import File, Store, directory, merged_name, new_id, split_live

#: Bytes of a file that is not merged any more, files of a merge (a name has 255 bytes), and how many
#: times the first file's size a further one of an open partition may have.
TARGET_BYTES = 128 << 20
MOST_SOURCES = 6
SPREAD = 8
#: A lock that is older is of a compactor that died; one merge takes far less.
STALE_SECONDS = 3600


def next_batch(files: Iterable[File], closed: bool, target: int = TARGET_BYTES) -> list[File]:
    """The files to merge next; empty if none should be."""
    batch: list[File] = []
    total, full = 0, False
    for f in sorted((f for f in files if f.size < target), key=lambda f: (f.size, f.name)):
        if batch and not closed and f.size > SPREAD * batch[0].size:
            batch, total = [], 0
        full = bool(batch) and total + f.size > target
        if full or len(batch) == MOST_SOURCES:
            break
        batch.append(f)
        total += f.size
    ready = closed or full or len(batch) == MOST_SOURCES
    return batch if ready and len(batch) > 1 else []


@dataclass(frozen=True)
class Report:
    before: int
    after: int

    def __str__(self) -> str:
        return f"compacted {self.before} files into {self.after}"


class Compactor:
    def __init__(self, store: Store, spec: RecordSpec, target: int = TARGET_BYTES, keep_sources: bool = False, stale_seconds: float = STALE_SECONDS):
        """``keep_sources`` leaves merged files to the next pass, for readers that still hold an older listing."""
        self.store, self.spec, self.target, self.keep_sources, self.stale_seconds = store, spec, target, keep_sources, stale_seconds
        self.owner = new_id().encode()

    def merge(self, value: str, sources: list[File]) -> str:
        """One file of the sources' rows, newest per key; its name is the commit, then the sources go."""
        rows = newest(self.store.read(self.spec, sources), self.spec)
        made = self.store.write_merged(self.spec, rows, value, merged_name(f.name for f in sources))
        if not self.keep_sources:
            for f in sources:
                self.store.files.delete(f.path)
        return made

    def partition(self, value: str, closed: bool) -> int:
        """Merges until no batch is left; the number of merges. One compactor works on a partition at a time."""
        lock = f"{self.store.table_path(self.spec)}/_locks/{directory(value)}"
        if not self._locked(lock):
            return 0
        try:
            done = 0
            while True:
                live, stale = split_live(self.store.all_files(self.spec, value))
                if not (self.keep_sources and done):
                    # What an earlier pass left goes first: once its merged file is merged too, nothing names it.
                    for f in stale:
                        self.store.files.delete(f.path)
                elif stale:
                    return done  # kept sources must be gone before their merged file is merged again
                batch = next_batch(live, closed, self.target)
                if not batch:
                    return done
                self.merge(value, batch)
                done += 1
                if self.store.files.exists(lock) and self.store.files.read(lock) != self.owner:
                    return done  # it was taken for dead; the other one goes on
                self.store.files.write(lock, self.owner)  # still alive
        finally:
            if self.store.files.exists(lock) and self.store.files.read(lock) == self.owner:
                self.store.files.delete(lock)

    def _locked(self, lock: str) -> bool:
        """Whether the lock is ours now. One that hasn't been renewed for long is of a compactor that died: it goes, and
        whoever makes the next one first has it."""
        files = self.store.files
        if files.create_once(lock, self.owner):
            return True
        age = files.age(lock)
        if age is not None and age > self.stale_seconds:
            files.delete(lock)
            return files.create_once(lock, self.owner)
        return False

    def run(self, at_once: int = 4) -> Report:
        """All partitions, several side by side; all but the newest are closed."""
        before = len(self.store.live_files(self.spec))
        values = self.store.partitions(self.spec)
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(lambda iv: self.partition(iv[1], iv[0] > 0), enumerate(values)))
        return Report(before, len(self.store.live_files(self.spec)))
